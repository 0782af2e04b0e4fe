"""Mixing of sources to target weights: each source gives its exact budget of words, repeating whole epochs if needed.

Every document gets a hash-random key. The documents are range-sorted by (source, key), which deals a source of any size over as many
tasks as its rows need; running sums inside the tasks plus the sums of the tasks before them give each document the words that come before it in its
source. A budget of e times the source's size and a rest is then e whole epochs and the documents before the rest's cut; the document at the
cut gives its first words only, so that a source's words are its budget exactly.

Targets: the sources in the order of code points (null last) weigh ``weights`` in turn and share ``share`` of all words. No target is above ``most`` times its
source's size: what is over is shared again by weight among the others until none is above. A budget is the target rounded to a word.

On the driver: one number for each task of the sort, and two for each round of targets. Sources are a table, however many. Texts
are read once, and only small rows (ids, sizes, keys and what is to be kept) are sorted.

Cases: a null or blank text has size 0 and gives nothing; null is a source of its own, the last; a source without words has target 0; a null id has the key
of an empty string. Documents of equal key stand in the order of id (null first) and size; rows equal in these are interchangeable, and
which of them the cut meets is fixed once the sizes are written. An empty table gives no rows; clashing names get underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.loop import numbered
from .common import fresh, prepare, settle, stored, with_group
from .textcore import BLANK_WORDS, Words, string_buffers

WORDS = r"[^\x20\x09-\x0D]+"
#: Sources whose few numbers are met by a broadcast; beyond, only those of many documents are.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, max_rounds: int = 10_000) -> DataFrame:
    """(source, docs, source_size, weight, target) from (source, docs, source_size).

    Each round shares what full sources leave among the others by weight; the share of a unit of weight only grows, so a full source stays full.
    A round brings two sums to the driver.
    """
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = settle(numbered(sizes, F.col("source").asc_nulls_last(), name="_rank").withColumn("weight", turn).drop("_rank"))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    total = total if share == 1 else round(total * share)
    top = F.col("source_size") * most
    full, left, weight = F.lit(False), total, None
    for _ in range(max_rounds):
        now = s.agg(F.coalesce(F.sum(F.when(full, top)), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if (total - now.given, now.weight) == (left, weight):
            break
        left, weight = total - now.given, now.weight
        full = top * weight < F.col("weight") * left  # its part would be above its top
    else:
        raise RuntimeError("targets did not settle")
    part = F.when(full, top.cast("double")).otherwise((F.col("weight") * left).cast("double") / F.lit(float(weight or 1)))
    return s.withColumn("target", part)


def _running(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of a column over the rows before, within each task; rows stay as they are dealt and sorted."""
    schema = df.withColumn(name, F.lit(0).cast("long")).schema
    arrow = to_arrow_schema(schema)
    at = df.columns.index(value)

    def run(batches):
        before = 0
        for b in batches:
            x = b.column(at).to_numpy(zero_copy_only=False)
            upto = before + np.cumsum(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - x, pa.int64())], schema=arrow)
            before = int(upto[-1]) if len(x) else before

    return df.mapInArrow(run, schema)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 42) -> DataFrame:
    """The kept columns (the id, if None) and size, source_size, target, epochs, part: a document comes ``epochs`` times whole and once with its first ``part`` words, if any."""
    prepare(docs.sparkSession)
    keep = [doc_id] if keep is None else keep
    base = docs.select(*keep)
    t = {}
    for x in ("_size", "_source", "_key", "_id", "_row", "_p", "_before"):
        t[x] = fresh(base, x)
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(*keep, size.alias(t["_size"]), F.col(source).alias(t["_source"]), key.alias(t["_key"]), F.col(doc_id).alias(t["_id"]))
    # written once: from here on a row's number is fixed, so equal rows have an order, and a key of many rows can be dealt to several tasks
    rows = stored(rows.withColumn(t["_row"], F.monotonically_increasing_id()))
    order = [F.col(t["_source"]).asc_nulls_last(), t["_key"], F.col(t["_id"]).asc_nulls_first(), t["_size"], t["_row"]]
    placed = stored(_running(rows.orderBy(*order).withColumn(t["_p"], F.spark_partition_id()), t["_size"], t["_before"]))
    first, total = [], 0
    for r in placed.groupBy(t["_p"]).agg(F.sum(t["_size"]).alias("n")).orderBy(t["_p"]).collect():
        first.append((r[0], total))
        total += r.n
    start = docs.sparkSession.createDataFrame(first, "task int, words_before long")
    placed = placed.join(F.broadcast(start), F.col(t["_p"]) == F.col("task")).withColumn(t["_before"], F.col(t["_before"]) + F.col("words_before")).drop("task", "words_before", t["_p"], t["_row"], t["_key"], t["_id"])
    by = placed.groupBy(F.col(t["_source"]).alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(t["_size"]).alias("source_size"), F.min(t["_before"]).alias("from"))
    by = settle(by)
    goal = targets(by, weights, share, most)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    goal = settle(goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.call_function("div", budget, F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    # null sources match too: a number stands for a source (hot sources meet their row by a bounded broadcast)
    sid = fresh(placed, "_sid")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    of, many = fresh(placed, "_of"), fresh(placed, "_docs")
    facts = goal.select(name("source").alias(sid), F.col("docs").alias(many), F.struct("source_size", "target", "epochs", "rest", "from").alias(of))
    rows_, n = placed.withColumn(sid, name(t["_source"])), goal.count()
    got = rows_.join(F.broadcast(facts), sid) if n <= BROADCAST_SOURCES else with_group(rows_, facts, sid, many, placed.count())
    own = F.col(of)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col(t["_size"]), own["rest"] - (F.col(t["_before"]) - own["from"])))
    names = [fresh(base, x) for x in ("size", "source_size", "target", "epochs", "part")]
    return got.select(*keep, *[c.alias(x) for c, x in zip((F.col(t["_size"]), own["source_size"], own["target"], own["epochs"], part), names, strict=True)])


@F.arrow_udf(T.StringType())
def _first_words(text: pa.Array, many: pa.Array) -> pa.Array:
    off, raw = string_buffers(text)
    off = off - off[0]
    w = Words(raw, off, BLANK_WORDS)
    n = np.minimum(many.to_numpy(zero_copy_only=False), np.diff(w.first))
    end = off[:-1].copy()
    some = n > 0
    end[some] = w.end[w.first[:-1][some] + n[some] - 1]
    data = raw.tobytes()
    return pa.array([data[a:b].decode() for a, b in zip(off[:-1].tolist(), end.tolist(), strict=True)], pa.string())


def emit(mixed: DataFrame, text: str = "text", epochs: str = "epochs", part: str = "part") -> DataFrame:
    """The documents of a mix that keeps their text: a row for each whole copy, and one with the first words where a part is taken."""
    copy = fresh(mixed, "copy")
    whole = mixed.where(F.col(epochs) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(epochs))))
    cut = mixed.where(F.col(part) > 0).withColumn(copy, F.col(epochs) + 1).withColumn(text, _first_words(F.col(text), F.col(part)))
    return whole.unionByName(cut)
