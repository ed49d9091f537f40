"""Case tables: hierarchy, stages, statuses, numbers, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.functions.text import catalog_key, similarity
from docketry.operators import ordered
from docketry.session import cut_lineage


# --- hierarchy --------------------------------------------------------------

def folder_chain(cases: DataFrame, levels: int = fv.MAX_FOLDER_DEPTH, folder_kind: int = fv.SUBFOLDER_KIND) -> DataFrame:
    """Root, depth and path of every case, following at most ``levels`` parents.

    ``cases(case_id, parent_id, subject, kind)``. Only a case of the sub-folder
    kind has its parent followed; any other is a root, whatever its parent. The
    walk doubles: a table of two steps comes from the one-step table joined to
    itself, then four and eight, so twelve levels take four joins. Each doubled
    table is written once.
    """
    known = cases.select(F.col("case_id").alias("parent_id"), F.lit(True).alias("known"))
    # A parent that is not in the table ends the walk: the case counts as a root.
    has_parent = F.coalesce("known", F.lit(False)) & F.coalesce(F.col("kind") == folder_kind, F.lit(False))
    one = cases.join(known, "parent_id", "left").select(
        "case_id",
        F.when(has_parent, F.col("parent_id")).otherwise(F.col("case_id")).alias("ancestor"),
        has_parent.cast("int").alias("depth"),
        F.when(has_parent, F.array("subject")).otherwise(F.lit([]).cast("array<string>")).alias("path"),
    )

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        further = second.select(
            F.col("case_id").alias("ancestor"), F.col("ancestor").alias("a2"),
            F.col("depth").alias("d2"), F.col("path").alias("p2"),
        )
        return first.join(further, "ancestor", "left").select(
            "case_id",
            F.coalesce("a2", "ancestor").alias("ancestor"),
            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            F.concat(F.coalesce("p2", F.lit([]).cast("array<string>")), "path").alias("path"),
        )

    steps, reached = one, None
    remaining = levels
    while remaining:
        if remaining & 1:
            reached = steps if reached is None else then(reached, steps)
        remaining >>= 1
        if remaining:
            steps = cut_lineage(then(steps, steps))
    return reached.withColumnRenamed("ancestor", "root_id")


def children(cases: DataFrame) -> DataFrame:
    """Number of direct sub-folders per case."""
    return cases.filter("parent_id is not null").groupBy(F.col("parent_id").alias("case_id")).agg(
        F.count(F.lit(1)).alias("n_children")
    )


# --- statuses ---------------------------------------------------------------

def status_list(catalog: DataFrame, cases: DataFrame) -> DataFrame:
    """Catalog names and names in use, with use counts and where each comes from."""
    named = catalog.select("bank_id", F.trim("name").alias("name")).filter("length(name) > 0")
    used = (
        cases.select(F.trim("status").alias("name")).filter("length(name) > 0").groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    )
    source = F.when(F.col("bank_id").isNotNull(), F.concat(F.lit("catalog#"), F.col("bank_id").cast("string"))).otherwise("used-in-cases")
    return named.join(used, "name", "full").select("name", source.alias("source"), F.coalesce("uses", F.lit(0)).alias("uses"))


def closest_names(text: Column, catalog: list[str], minimum: float = fv.SIMILAR_MIN) -> Column:
    """Up to five names of a short fixed list most like a text, best first: ``array<struct<neg, name>>``."""
    scored = F.transform(
        F.array(*[F.lit(n) for n in catalog]),
        lambda name: F.struct((-similarity(text, name)).alias("neg"), name.alias("name")),
    )
    return F.slice(F.array_sort(F.filter(scored, lambda s: -s["neg"] >= minimum)), 1, fv.SIMILAR_LIMIT)


def similar_names(requests: DataFrame, text: str, catalog: list[str], minimum: float = fv.SIMILAR_MIN) -> DataFrame:
    """Up to five catalog names most like each distinct request text; each is scored once."""
    top = closest_names(F.col(text), catalog, minimum)
    return requests.select(text).distinct().select(text, F.posexplode(top).alias("i", "s")).select(
        text, (F.col("i") + 1).alias("rank"), F.col("s.name").alias("name"), (-F.col("s.neg")).alias("score")
    )


# --- stages and numbers -----------------------------------------------------

def current_stage(flow: DataFrame) -> DataFrame:
    """Latest stage row of each case; equal times go to the larger flow id."""
    latest = F.max(F.struct("change_date", "flow_id", "node_id")).alias("m")
    return flow.groupBy("case_id").agg(latest).select("case_id", "m.flow_id", "m.node_id", "m.change_date")


def stage_catalog(cases: DataFrame, flow: DataFrame, models: dict[int, list[tuple[str, str]]]) -> DataFrame:
    """Every stage of the process model of each case, the current one marked.

    ``cases(case_id, kind, current_flow_id)``; ``models`` gives the stages
    ``(node, caption)`` of a kind, a short fixed table. A kind without a model
    has no stages.
    """
    nodes = F.create_map(
        *[v for kind, stages in models.items() for v in (
            F.lit(kind), F.array(*[F.struct(F.lit(n).alias("node_id"), F.lit(c).alias("caption")) for n, c in stages])
        )]
    )
    now = flow.select(F.col("flow_id").alias("current_flow_id"), F.col("node_id").alias("at"))
    placed = cases.select("case_id", "kind", "current_flow_id").join(now, "current_flow_id", "left")
    listed = placed.select("case_id", "at", F.explode(F.try_element_at(nodes, F.col("kind"))).alias("n"))
    return listed.select("case_id", "n.node_id", "n.caption", F.coalesce(F.col("n.node_id") == F.col("at"), F.lit(False)).alias("is_current"))


def stage_pointer_mismatches(cases: DataFrame, flow: DataFrame) -> DataFrame:
    """Cases whose stored current flow is not their latest stage row."""
    latest = current_stage(flow).select("case_id", F.col("flow_id").alias("latest_flow_id"))
    joined = cases.select("case_id", "current_flow_id").join(latest, "case_id", "left")
    return joined.filter(~F.col("current_flow_id").eqNullSafe(F.col("latest_flow_id")))


def stage_durations(flow: DataFrame) -> DataFrame:
    """Seconds until the next stage row of the case; null for the current one."""
    chunk = F.floor(F.unix_timestamp("change_date") / 86400)
    moved = ordered.next_value(flow, ["case_id"], ["change_date", "flow_id"], "change_date", chunk, "left_at")
    return moved.withColumn("seconds", F.unix_timestamp("left_at") - F.unix_timestamp("change_date"))


def number_new_cases(requests: DataFrame, cases: DataFrame, order: list[Column]) -> DataFrame:
    """Consecutive case numbers after the highest number in use, with the padded sort key."""
    highest = cases.agg(F.coalesce(F.max(F.col("case_num").try_cast("int")), F.lit(0))).scalar()
    placed = ordered.position_of_all(requests, order, "__at")
    number = (highest + F.col("__at")).cast("string")
    return placed.withColumn("case_num", number).withColumn("case_num_sort", F.lpad(number, 8, "0")).drop("__at")


# --- events -----------------------------------------------------------------

Templates = dict[int, tuple[str, int | None, int | None, int]]


def _template(key: Column, templates: Templates) -> Column:
    """A fixed table as a literal map, so no join deals the requests out by a handful of kinds."""
    rows = [
        v for k, (kind, product, colour, alarm) in templates.items() for v in (
            F.lit(k),
            F.struct(
                F.lit(kind).alias("type"), F.lit(product).cast("int").alias("product"), F.lit(colour).cast("int").alias("colour"),
                F.lit(alarm).alias("alarm"),
            ),
        )
    ]
    return F.try_element_at(F.create_map(*rows), key)


def event_rows(
    requests: DataFrame, vat: str, now: Column, templates: Templates = fv.EVENT_TEMPLATES, groups: Templates = fv.GROUP_TEMPLATES
) -> DataFrame:
    """Calendar, task, call, note and damage rows filled in from the template of their kind.

    ``requests(request_id, kind, kind_group, day, start_minutes, end_minutes,
    amount)``. A kind without a template takes its group's; with neither the
    row is rejected. Times are minutes after midnight, money is decimal.
    ``now`` is the time of writing, at which calls without a start and damages begin.
    """
    money = "decimal(18,2)"
    joined = requests.withColumn("t", _template(F.col("kind"), templates)).withColumn("g", _template(F.col("kind_group"), groups))
    joined = joined.withColumn("t", F.coalesce("t", "g")).drop("g")
    kind_type = F.col("t.type")
    default = F.when(kind_type == "cal", fv.EVENT_START).when(kind_type == "task", fv.TASK_START).when(kind_type == "call", now)
    start = F.coalesce("start_minutes", default)
    timed = kind_type.isin("cal", "task", "call")
    alarm = F.col("t.alarm")
    amount = F.coalesce(F.col("amount").cast(money), F.lit(fv.DAMAGE_DEFAULT).cast(money))
    gross = F.bround(amount * (F.lit(1) + F.lit(vat).cast("decimal(5,2)") / 100), 2).cast(money)
    return joined.select(
        "request_id", "kind", kind_type.alias("row_type"), "day",
        F.when(timed, start).when(kind_type == "damage", now).cast("int").alias("start_minutes"),
        F.when(kind_type == "cal", F.coalesce("end_minutes", start + fv.EVENT_MINUTES)).cast("int").alias("end_minutes"),
        F.when(timed & (alarm > 0), start - alarm).cast("int").alias("alarm_minutes"),
        F.col("t.product").alias("product"), F.col("t.colour").alias("colour"),
        (kind_type == "cal").alias("has_basket_row"),
        F.when(kind_type == "damage", gross).alias("bill_sum"),
        kind_type.isNull().alias("rejected"),
    )


def enrich(acts: DataFrame, catalogs: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins to catalogs. Which side is copied is left to the optimizer, which checks sizes."""
    out = acts
    for catalog, keys in catalogs:
        out = out.join(catalog, keys, "left")
    return out


def files_present(acts: DataFrame, files: DataFrame, rerooted: Column) -> DataFrame:
    """Acts that name a file, and whether it stands in the listing under the current root."""
    listed = files.select(F.col("path").alias("__path")).distinct().withColumn("__there", F.lit(True))
    named = acts.filter(F.length("doc_path") > 0).withColumn("__path", rerooted)
    return named.join(listed, "__path", "left").withColumn(
        "file_state", F.when(F.col("__there"), "file OK").otherwise("FILE MISSING")
    ).drop("__path", "__there")
