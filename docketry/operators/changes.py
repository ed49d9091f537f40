"""Planned changes to tables: validation, plan, application, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.functions.text import catalog_key, similarity
from docketry.operators.cases import closest_names
from docketry.operators.joining import shuffled

FOLDER_UNITS = 32  # units that the paths below one folder are dealt over

# --- plan and apply ---------------------------------------------------------

def change_plan(changes: DataFrame) -> DataFrame:
    """The dry run: one readable line per change, in a stable column order.

    ``changes(op, table_name, key, set map<string,string>)``.
    """
    pairs = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("set")), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("")))
        ),
        "; ",
    )
    text = (
        F.when(F.col("op") == "insert", F.concat(F.lit("INSERT "), "table_name", F.lit(" : "), pairs))
        .when(F.col("op") == "update", F.concat(F.lit("UPDATE "), "table_name", F.lit(" SET "), pairs, F.lit(" WHERE key="), "key"))
        .otherwise(F.concat(F.lit("DELETE FROM "), F.col("table_name"), F.lit(" WHERE key="), F.col("key")))
    )
    return changes.select("op", "table_name", "key", text.alias("plan"))


def apply_changes(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The next version of ``base`` after ``changes(op, key, set, seq)``, applied in the order of ``seq``.

    A delete removes the row. An update changes only the named columns of a row
    that is there, and does nothing for an absent key. An insert brings an
    absent key back with the named columns alone; for a key that is there it
    changes the named columns. Per key that is the last delete, the first
    insert after it, and per column the last value after it, all of them
    partial aggregates. The caller writes the result as a new version.
    """
    values = [f for f in base.schema.fields if f.name != key]
    keyed_changes = changes.filter("key is not null")
    gone = keyed_changes.filter("op = 'delete'").groupBy("key").agg(F.max("seq").alias("__gone"))
    after = keyed_changes.filter("op <> 'delete'").join(gone, "key", "left").filter("__gone is null or seq > __gone")
    last = [
        F.max(F.when(F.map_contains_key("set", f.name), F.struct("seq", F.col("set")[f.name].alias("value")))).alias(f"__{f.name}")
        for f in values
    ]
    made = after.groupBy("key").agg(F.min(F.when(F.col("op") == "insert", F.col("seq"))).alias("__born"), *last)
    touched = gone.join(made, "key", "full").withColumnRenamed("key", "__key")
    keyed = base.withColumn("__key", F.col(key).cast("string")).withColumn("__there", F.lit(True))
    joined = keyed.join(touched, "__key", "full")
    stays = F.col("__there").isNotNull() & F.col("__gone").isNull()
    columns = []
    for field in base.schema.fields:
        if field.name == key:
            value = F.coalesce(F.col(key), F.col("__key").try_cast(field.dataType))
        else:
            new = F.col(f"__{field.name}")
            written = new.isNotNull() & (stays | (new["seq"] >= F.col("__born")))
            value = F.when(written, new["value"].try_cast(field.dataType)).when(stays, F.col(field.name))
        columns.append(value.alias(field.name))
    return joined.filter(stays | F.col("__born").isNotNull()).select(*columns)


def delete_acts(acts: DataFrame, requests: DataFrame, calendar_kinds: list[str], user: str) -> dict[str, DataFrame]:
    """Remaining acts, audit rows and recycle rows for deleted acts.

    ``acts(act_id, kind, text, due, sender, receiver)``, ``requests(act_id, ts)``.
    """
    asked = requests.groupBy("act_id").agg(F.min("ts").alias("ts"))
    gone = acts.join(asked, "act_id")
    notes = F.concat_ws(
        ", ", F.coalesce("text", F.lit("")), F.date_format("due", "dd/MM/yyyy"),
        F.coalesce("sender", F.lit("")), F.coalesce("receiver", F.lit("")),
    )
    return {
        "acts": acts.join(asked, "act_id", "left_anti"),
        "audit": gone.select(
            F.col("ts").alias("del_date"), F.col("kind").alias("del_type"), notes.alias("del_notes"), F.lit(user).alias("del_user")
        ),
        "recycle": gone.filter(F.col("kind").isin(*calendar_kinds)).select("act_id"),
    }


# --- validated requests -----------------------------------------------------

def judge_status_requests(
    requests: DataFrame, cases: DataFrame, catalog: list[str], uses: DataFrame, closed: str = fv.CLOSED_STATUS
) -> DataFrame:
    """Each status request with the reason it is refused; null means accepted.

    A request refused for an unknown or a too similar text comes with up to
    five catalog names like it, scored once per distinct text.

    ``requests(request_id, action, case_id, text)`` with actions ``set``,
    ``close``, ``reopen``, ``add`` and ``remove``; ``cases(case_id, kind,
    close_date)``; ``uses(status, n)``. The catalog is a short fixed list.
    """
    names = F.array(*[F.lit(n) for n in catalog])
    text = F.trim(F.coalesce("text", F.lit("")))
    key = catalog_key(text)
    used_keys = uses.select(catalog_key(F.col("status")).alias("used_key"), "n").groupBy("used_key").agg(F.sum("n").alias("n"))
    joined = (
        requests.join(cases, "case_id", "left")
        .withColumn("used_key", key)
        .join(used_keys, "used_key", "left")
    )
    in_catalog = F.exists(names, lambda n: catalog_key(n) == key)
    known = in_catalog | F.col("n").isNotNull()
    similar = F.exists(names, lambda n: similarity(text, n) >= fv.SIMILAR_GUARD)
    needs_case = F.col("action").isin("set", "close", "reopen")
    reason = (
        F.when(needs_case & F.col("kind").isNull(), "no such case")
        .when(needs_case & (F.col("kind") == fv.SUBFOLDER_KIND), "sub-folders have no status")
        .when(F.col("action").isin("set", "add", "remove") & (F.length(text) == 0), "text required")
        .when((F.col("action") == "set") & (text == closed), "closing needs the close action")
        .when((F.col("action") == "set") & F.col("close_date").isNotNull(), "case is closed")
        .when((F.col("action") == "reopen") & (text == closed), "reopen with another status")
        .when((F.col("action") == "set") & ~known, "status unknown")
        .when((F.col("action") == "reopen") & (F.length(text) > 0) & ~known, "status unknown")
        .when((F.col("action") == "add") & known, "already exists")
        .when((F.col("action") == "add") & similar, "similar statuses exist")
        .when((F.col("action") == "remove") & ~in_catalog, "not in the catalog")
        .when((F.col("action") == "remove") & (text == closed), "system status")
        .when((F.col("action") == "remove") & F.col("n").isNotNull(), "in use")
    )
    judged = joined.select("request_id", "action", "case_id", text.alias("text"), reason.alias("refused"))
    unclear = F.col("refused").isin("status unknown", "similar statuses exist")
    names_of = lambda least: F.array_join(F.transform(closest_names(F.col("text"), catalog, least), lambda s: s["name"]), "; ")
    listed = judged.filter(unclear).select("text", "refused").distinct().withColumn(
        "suggestions", F.nullif(F.when(F.col("refused") == "status unknown", names_of(fv.SIMILAR_MIN)).otherwise(names_of(fv.SIMILAR_GUARD)), F.lit(""))
    )
    return judged.join(listed, ["text", "refused"], "left").select("request_id", "action", "case_id", "text", "refused", "suggestions")


def judge_flow_deletes(requests: DataFrame, flow: DataFrame, cases: DataFrame, acts: DataFrame) -> DataFrame:
    """Stage-history deletes: only rows of the same case that are neither current nor referenced.

    ``requests(request_id, case_id, flow_id)``, ``acts(flow_id)``.
    """
    used = acts.filter("flow_id is not null").groupBy("flow_id").agg(F.count(F.lit(1)).alias("n_acts"))
    joined = (
        requests.join(flow.select("flow_id", F.col("case_id").alias("owner")), "flow_id", "left")
        .join(cases.select("case_id", "current_flow_id"), "case_id", "left")
        .join(used, "flow_id", "left")
    )
    reason = (
        F.when(F.col("owner").isNull(), "not found")
        .when(F.col("owner") != F.col("case_id"), "another case")
        .when(F.col("current_flow_id") == F.col("flow_id"), "current stage")
        .when(F.col("n_acts") > 0, "referenced")
    )
    return joined.select("request_id", "case_id", "flow_id", reason.alias("refused"))


def judge_new_names(requests: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose name already exists, or that another request of the batch brings first.

    ``requests(request_id, *keys)``. The first request of each name is a
    partial aggregate, so one name that everybody asks for stays cheap.
    """
    taken = existing.select(*keys).distinct().withColumn("taken", F.lit(True))
    first = requests.groupBy(*keys).agg(F.min("request_id").alias("first_id"))
    judged = requests.join(first.join(taken, keys, "left"), keys)
    reason = F.when(F.col("taken"), "exists").when(F.col("request_id") != F.col("first_id"), "twice in batch")
    return judged.select("request_id", *keys, reason.alias("refused"))


def rename_paths(acts: DataFrame, renames: DataFrame, path: str) -> DataFrame:
    """Rewrite every path below a renamed folder.

    ``renames(old_folder, new_folder)``. Each path meets a rename by equality
    on one of its own folder prefixes, so no pattern is tried against every
    path. The longest prefix wins; letter case does not matter.
    """
    parts = F.split(F.col(path), r"[\\/]")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.lower(F.array_join(F.slice(parts, 1, n), "/"))
    )
    moves = renames.select(
        F.lower(F.translate("old_folder", "\\", "/")).alias("prefix"), F.length("old_folder").alias("cut"), "new_folder"
    )
    # Every path has the topmost folders, so a folder's paths are dealt over several units and each rename goes to all of them.
    unit = F.pmod(F.xxhash64("act_id", path), F.lit(FOLDER_UNITS)).cast("int").alias("unit")
    dealt = moves.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(FOLDER_UNITS - 1))))
    nested = acts.filter(F.size(parts) > 1)
    hit = nested.select("act_id", unit, F.explode(prefixes).alias("prefix")).join(shuffled(dealt), ["prefix", "unit"])
    best = hit.groupBy("act_id").agg(F.max(F.struct("cut", "new_folder")).alias("m"))
    joined = acts.join(shuffled(best), "act_id", "left")
    moved = F.concat(F.col("m.new_folder"), F.substring(F.col(path), F.col("m.cut") + 1, F.length(path)))
    return joined.withColumn("new_path", F.when(F.col("m").isNull(), F.col(path)).otherwise(moved)).drop("m")


def new_case_rows(requests: DataFrame) -> dict[str, DataFrame]:
    """One numbered request to its rows in the case tables.

    ``requests(request_id, customer_id, full_name, kind, day, case_num,
    case_num_sort)``. Identifiers are hashes of the request, so a repeated run
    gives the same rows. A kind outside the table is left out of every table
    and listed under ``rejected``.
    """
    types = F.create_map(*[x for k, v in fv.CASE_TYPES.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("node"), F.lit(v[1]).alias("caption"), F.lit(v[2]).alias("vals")))])
    typed = requests.withColumn("t", F.try_element_at(types, F.coalesce("kind", F.lit(24))))
    good = typed.filter("t is not null").withColumn("case_id", F.xxhash64("request_id", F.lit("case"))).withColumn(
        "flow_id", F.xxhash64("request_id", F.lit("flow"))
    )
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("full_name", '"', ""), r"[\\/:*?<>|]", " "), r"\s{2,}", " "))
    return {
        "case": good.select(
            "case_id", "customer_id", "case_num", "case_num_sort", F.col("day").alias("open_date"), "kind",
            F.col("flow_id").alias("current_flow_id"), F.col("t.caption").alias("node_caption"), name.alias("case_name"),
        ),
        "flow": good.select("flow_id", "case_id", F.col("t.node").alias("node_id"), F.col("day").alias("change_date")),
        "detail": good.select(F.xxhash64("request_id", F.lit("detail")).alias("detail_id"), "case_id"),
        "values": good.filter("t.vals").select(
            "case_id", F.explode(F.array(*[F.lit(i) for i in fv.TORT_VALUE_ITEMS])).alias("item"), F.col("day").alias("value_date")
        ),
        "rejected": typed.filter("t is null").select("request_id", "kind"),
    }


# --- registry ---------------------------------------------------------------

def merge_registry(registry: DataFrame, updates: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Upserted registry with its use counters moved on.

    ``updates`` holds the key, ``ts`` and new values, null meaning keep;
    ``uses(key, ts)``. Both sides are reduced to one row per key first.
    """
    values = [c for c in registry.columns if c not in (key, "use_count", "last_used", "updated_at")]
    newest = updates.groupBy(key).agg(
        F.max("ts").alias("__ts"), *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"__{c}") for c in values]
    )
    used = uses.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__last"))
    joined = registry.join(newest, key, "full").join(used, key, "left")
    return joined.select(
        key,
        *[F.coalesce(f"__{c}", c).alias(c) for c in values],
        F.greatest("updated_at", "__ts").alias("updated_at"),
        (F.coalesce("use_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("long").alias("use_count"),
        F.greatest("last_used", "__last").alias("last_used"),
    )


def append_absent(target: DataFrame, additions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``additions`` that ``target`` lacks, once each, added to it.

    Of several additions with equal keys the one with the smallest other values
    is taken, column by column from the left.
    """
    rest = [c for c in additions.columns if c not in keys]
    if rest:
        once = additions.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__first")).select(*keys, *[F.col("__first")[c].alias(c) for c in rest])
    else:
        once = additions.distinct()
    fresh = once.select(*additions.columns).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh)


def registry_statistics(registry: DataFrame, key: str) -> DataFrame:
    """Entries, distinct topics, total use and the most used entry (smallest key on a tie)."""
    most = F.max(F.struct("use_count", (-F.col(key)).alias("neg"))).alias("m")
    totals = registry.agg(F.count(F.lit(1)).alias("entries"), F.sum("use_count").alias("total_use"), most)
    topics = registry.select(F.explode("topics").alias("t")).agg(F.count_distinct("t")).scalar()
    return totals.select(
        "entries", topics.alias("topics"), "total_use", (-F.col("m.neg")).alias("most_used")
    )


