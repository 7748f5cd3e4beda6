"""Facts with validity intervals [valid_from, valid_to) over a linear sequence."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import exported, version_key
from factloom.schemas import DISPATCHED


def valid_at(seq, vf: str = "valid_from", vt: str = "valid_to") -> Column:
    return (F.col(vf) <= seq) & (F.col(vt).isNull() | (F.col(vt) > seq))


def as_of(facts: DataFrame, seq) -> DataFrame:
    return facts.where(valid_at(F.lit(seq)))


def live(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("valid_to").isNull())


def attribution(facts: DataFrame, commits: DataFrame) -> DataFrame:
    """facts with the commits that introduced and removed them."""
    born = commits.select(F.col("seq").alias("valid_from"), F.col("commit_hash").alias("introduced_by"))
    gone = commits.select(F.col("seq").alias("valid_to"), F.col("commit_hash").alias("removed_by"))
    return facts.join(born, "valid_from").join(gone, "valid_to", "left")


def changed_keys(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are new, gone, or have another value."""
    a, b = old.select(key, F.col(value).alias("__a")), new.select(key, F.col(value).alias("__b"))
    return a.join(b, key, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(key)


def scd2_apply(current: DataFrame, incoming: DataFrame, key: str, value: str, seq: int, close_missing: bool) -> DataFrame:
    """The interval relation (key, value, valid_from, valid_to) after ``incoming`` (key, value) at ``seq``."""
    closed, open_ = current.where("valid_to is not null"), live(current)
    new = incoming.select(F.col(key), F.col(value).alias("__new"), F.lit(True).alias("__in"))
    joined = open_.withColumn("__old", F.lit(True)).join(new, key, "full_outer")
    same = F.col(value).eqNullSafe(F.col("__new"))
    ends = F.col("__old") & F.when(F.col("__in"), ~same).otherwise(F.lit(close_missing))
    old = joined.where("__old").withColumn("valid_to", F.when(ends, F.lit(seq).cast("long"))).select(current.columns)
    opened = joined.where(F.col("__in") & (F.col("__old").isNull() | ~same)).select(F.col(key), F.col("__new").alias(value), F.lit(seq).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return closed.select(current.columns).unionByName(old).unionByName(opened.select(current.columns))


def scd2_changes(open_rows: DataFrame, incoming: DataFrame, key: str, value: str, seq: int, close_missing: bool) -> DataFrame:
    """What scd2_apply closes or opens at ``seq``, from the open rows alone; rows that stay as they are do not appear."""
    after = scd2_apply(open_rows, incoming, key, value, seq, close_missing)
    return after.where((F.col("valid_from") == seq) | (F.col("valid_to") == seq))


def membership_changes(open_rows: DataFrame, now: DataFrame, key: str, seq: int) -> DataFrame:
    """(key, valid_from, valid_to) of what leaves or enters a set at ``seq``; open_rows are its open intervals."""
    gone = open_rows.join(now, key, "left_anti").select(key, "valid_from", F.lit(seq).cast("long").alias("valid_to"))
    come = now.select(key).distinct().join(open_rows, key, "left_anti")
    return gone.unionByName(come.select(key, F.lit(seq).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to")))


def apply_facts(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key and action: open, close or unchanged, from live facts and the facts derived now; duplicates of a key collapse."""
    a, b = old.select(*key).distinct().withColumn("__old", F.lit(1)), new.select(*key).distinct().withColumn("__new", F.lit(1))
    action = F.when(F.col("__old").isNull(), "open").when(F.col("__new").isNull(), "close").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


def stale(derivations: DataFrame, current: DataFrame, facts: DataFrame) -> DataFrame:
    """Ids of live facts with an input whose hash is not the current one, for all changed inputs at once."""
    now = current.select("input_kind", "input_key", F.col("input_hash").alias("__now"))
    moved = derivations.join(now, ["input_kind", "input_key"]).where("input_hash <> __now").select("fact_id").distinct()
    return live(facts).join(moved, "fact_id", "left_semi")


def precision(withdrawn: DataFrame, needed: DataFrame, key: list[str]) -> DataFrame:
    """One row: facts withdrawn, facts that had to be, those of them that were missed, and the ratio (null if none had to be)."""
    a, b = withdrawn.select(*key).distinct().withColumn("__w", F.lit(1)), needed.select(*key).distinct().withColumn("__n", F.lit(1))
    out = a.join(b, key, "full_outer").agg(F.count("__w").alias("withdrawn"), F.count("__n").alias("needed"), F.count_if(F.col("__w").isNull()).alias("missed"))
    return out.withColumn("ratio", F.when(F.col("needed") > 0, F.col("withdrawn") / F.col("needed")))


def vulnerable(reached: DataFrame, modules: DataFrame, advisories: DataFrame, seq) -> DataFrame:
    """(osv_id, module, version, sym): reached symbols named by an advisory (osv_id, module, introduced, fixed, sym) of
    a module whose version live at seq is at least ``introduced`` and below ``fixed`` (null: no bound)."""
    at = as_of(modules, seq).select("module", "version")
    version = version_key(F.col("version"))
    low = F.col("introduced").isNull() | (version >= version_key(F.col("introduced")))
    high = F.col("fixed").isNull() | (version < version_key(F.col("fixed")))
    return advisories.join(reached.select("sym"), "sym", "left_semi").join(at, "module").where(low & high).select("osv_id", "module", "version", "sym").distinct()


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def only_in(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_anti")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last in order: what repeated upserts leave."""
    return first_wins(rows.withColumns({f"__{c}": F.col(c) for c in order}), key, [F.desc(f"__{c}") for c in order]).drop(*[f"__{c}" for c in order])


def change_log(facts: DataFrame, key: list[str]) -> DataFrame:
    """key, seq, op: an open for each interval's begin and a close for its end."""
    op = lambda at, name: facts.where(F.col(at).isNotNull()).select(*key, F.col(at).alias("seq"), F.lit(name).alias("op"))
    return op("valid_from", "open").unionByName(op("valid_to", "close"))


def intervals(log: DataFrame, key: list[str]) -> DataFrame:
    """key, valid_from, valid_to from a log in which opens and closes of a key take turns; a close counts before an open of its seq."""
    w = Window.partitionBy(*key).orderBy("seq", "op")
    return log.withColumn("valid_to", F.lead("seq").over(w)).where("op = 'open'").select(*key, F.col("seq").alias("valid_from"), "valid_to")


def recorded_hashes(derivations: DataFrame) -> DataFrame:
    """(input_key, input_hash): the hash that the first fact of each FILE input has recorded."""
    return derivations.where("input_kind = 'FILE'").groupBy("input_key").agg(F.min_by("input_hash", "fact_id").alias("input_hash"))


def withdraw_dispatched(facts: DataFrame, callers: DataFrame) -> DataFrame:
    """facts without the interface calls of callers (src)."""
    dispatched = F.col("prov") == DISPATCHED
    return facts.where(~dispatched).unionByName(facts.where(dispatched).join(callers.select("src").distinct(), "src", "left_anti").select(facts.columns))


def report(a: DataFrame, b: DataFrame, key: list[str], rows: int = 10) -> DataFrame:
    """side, key, more: the first rows that only one of two sets has, and how many more there are."""
    out = None
    for side, one, other in (("a", a, b), ("b", b, a)):
        only = only_in(one, other, key)
        total = only.agg(F.count("*").alias("n"))
        part = only.orderBy(*key).limit(rows).join(F.broadcast(total)).select(F.lit(side).alias("side"), *key, F.greatest(F.col("n") - rows, F.lit(0).cast("long")).alias("more"))  # one row
        out = part if out is None else out.unionByName(part)
    return out


def without_snapshot(rows: DataFrame, commit: str) -> DataFrame:
    """rows (commit_hash, ...) without those of one commit."""
    return rows.where(F.col("commit_hash") != commit)


def missing_entry_points(defined: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Audit: exported functions and methods of a library (no main) that are no entry point."""
    named = defined.where(F.col("kind").isin("function", "method") & exported(F.col("name"))).select(F.col("qualified_name").alias("sym"))
    return named.join(entry_points, "sym", "left_anti")


def dead_module_facts(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """Audit: live facts (module, version, valid_to) of a module version that is not live (modules: module, version)."""
    return live(facts).where("module is not null").join(modules.select("module", "version"), ["module", "version"], "left_anti")


def begun_by(facts: DataFrame, skipped: DataFrame) -> DataFrame:
    """Audit: facts that begin at a skipped commit (seq)."""
    return facts.join(skipped.select(F.col("seq").alias("valid_from")), "valid_from", "left_semi")


def moved_inputs(derivations: DataFrame, current: DataFrame) -> DataFrame:
    """Audit: recorded inputs (input_kind, input_key, input_hash) whose current hash is another one."""
    now = current.select("input_kind", "input_key", F.col("input_hash").alias("__now"))
    return derivations.join(now, ["input_kind", "input_key"]).where("input_hash <> __now")


def fingerprints(commits: DataFrame) -> DataFrame:
    """(repo, seq, fingerprint): SHA-256 over the hashes up to seq, each ended by a newline.

    A chain can only be followed in order, so each repository's commits, a line each, are one group; every hash is read once.
    """

    def chain(rows: pa.Table) -> pa.Table:
        rows, state, out = rows.sort_by("seq"), hashlib.sha256(), []
        for h in rows.column("commit_hash").to_pylist():
            state.update(f"{h}\n".encode() if h is not None else b"")
            out.append(state.hexdigest())
        return rows.drop_columns(["commit_hash"]).append_column("fingerprint", pa.array(out, pa.string()))

    given = commits.select("repo", "seq", "commit_hash")
    return given.groupBy("repo").applyInArrow(chain, given.drop("commit_hash").schema.add("fingerprint", "string"))


def open_facts(current: DataFrame, rows: DataFrame, key: list[str], seq: int) -> DataFrame:
    """current with an interval from ``seq`` for each of rows; a row that is open already, or there twice, is an error when the result is read."""
    known = live(current).select(*[F.col(c).alias(f"__{c}") for c in key], F.lit(True).alias("__open"))
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    checked = rows.join(known, met, "left").withColumn("__n", F.count("*").over(Window.partitionBy(*key)))
    twice = F.col("__open") | (F.col("__n") > 1)
    words = F.concat(F.lit("open already: "), F.to_json(F.struct(*key)))
    checked = checked.where(F.when(F.coalesce(twice, F.col("__n") > 1), F.raise_error(words).cast("boolean")).otherwise(True))
    opened = checked.withColumns({"valid_from": F.lit(seq).cast("long"), "valid_to": F.lit(None).cast("long")})
    return current.unionByName(opened.select(current.columns))
