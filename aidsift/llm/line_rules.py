"""Quality rules with line frequency across documents (operator 12).

Base rules look at one text: words, symbols, repeated lines and words in
repeated 5-word windows. The method looks across texts: each line is
normalised (A-Z lowered, words joined by one blank) and hashed, the distinct
documents of each host (``source``) that hold it are counted, and a line that
more than ``max_share`` percent of the host's documents and more than ``min_docs`` of
them hold is removed as boilerplate. A document with fewer than
``MIN_WORDS`` words left, or less than ``min_left`` percent of its words, is depleted and
rejected. Documents of one host with the same text are one document, so
copies of a text do not make boilerplate of it; they are the work of
the near-duplicate operator.

Scale: lines leave a task as hashes, distinct within their document; (host,
line, text) is made distinct before it is counted, so a line or a host of a third of
all rows is pre-aggregated and spread; the removals join lines with the
few frequent ones on salted keys.

* A null or empty text has no words and fails the base rules.
* A null host is a host of its own.
* Repeated rows are judged each on its own, and count once.
* A very long text is one row of arrays; its lines are split one by one.
* An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .wordhash import flat, mix, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20  # percent of the words
MIN_DOCS = 10
MAX_SHARE = 5  # percent of the host's documents
MIN_LEFT = 20  # percent of the words
SALTS = 32

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: First bytes of code points outside blanks.
_INK = np.array([b & 0xC0 != 0x80 and b not in (0x20, *range(0x09, 0x0E)) for b in range(256)])


def line_hash(line: bytes) -> int | None:
    """Hash of a normalised line as a signed long; None for a line without words."""
    found = line.lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(found)) - (1 << 63) if found else None


def lines_of(text: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier one, and the words under each normalised line's hash."""
    seen, twice, under = set(), 0, {}
    for line in text.split(b"\n"):
        found = line.lower().split()
        if not found:
            continue
        twice += line in seen
        seen.add(line)
        h = xxhash.xxh3_64_intdigest(b" ".join(found)) - (1 << 63)
        under[h] = under.get(h, 0) + len(found)
    return twice, under


def repeated_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and those in windows of ``WINDOW`` words that the text has twice or more."""
    n_words, n_repeat = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for w in words(texts):
        n_words[w.first:w.first + w.rows] = np.diff(w.off)
        grams, whole = w.grams(WINDOW)
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        key = mix(grams[at] + mix(w.row_of()[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), dtype=bool)
        again[order[1:][equal]] = again[order[:-1][equal]] = True
        edges = np.zeros(len(w.hashes) + 1, dtype=np.int64)
        np.add.at(edges, at[again], 1)
        np.add.at(edges, at[again] + WINDOW, -1)
        covered = np.append(0, np.cumsum(np.cumsum(edges[:-1]) > 0))
        n_repeat[w.first:w.first + w.rows] = covered[w.off[1:]] - covered[w.off[:-1]]
    return n_words, n_repeat


def _host(column: str):
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _text_hash(column: str):
    """128 bits of the text; a null text is the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The base figures of each row, its host, its text's hash and its distinct lines (hash, words)."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            n_words, n_repeat = repeated_words(texts)
            data, off = flat(texts)
            chars, symbols, twice, lines = [], [], [], []
            for a, b in zip(off[:-1], off[1:]):
                text = data[a:b]
                chars.append(np.count_nonzero(_INK[text]))
                symbols.append(np.count_nonzero(_SYMBOL[text]))
                again, under = lines_of(text.tobytes())
                twice.append(again)
                lines.append([{"h": h, "n": n} for h, n in under.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n_words), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()),
                 pa.array(twice, pa.int64()), pa.array(n_repeat), pa.array(lines, kind)],
                names=["doc_id", "host", "same", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _host(host_col).alias("host"), _text_hash(text_col).alias("same"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, same binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, lines array<struct<h:long,n:long>>").withColumn("row", F.monotonically_increasing_id())


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, max_share: int = MAX_SHARE) -> DataFrame:
    """``host, h, n_docs``: lines above the limits of their host, of the rows of ``measured``."""
    held = rows.select("host", "same", F.explode("lines.h").alias("h")).distinct()
    counted = held.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = rows.select("host", "same").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    # one host may own a third of the lines: its one row is repeated under every salt
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = counted.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    return counted.join(hosts, ["host", "salt"]).where(100 * F.col("n_docs") > max_share * F.col("host_docs")).select("host", "h", "n_docs")


def _removed(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, h, n) of each removed line."""
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    lines = lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    salted = frequent.select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.join(salted, ["host", "h", "salt"]).select("row", "h", "n")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS,
          max_share: int = MAX_SHARE, min_left: int = MIN_LEFT) -> DataFrame:
    """A row per document: base figures, ``n_left`` words outside removed lines, ``base_failed``, ``kept``."""
    rows = written(measured(docs, id_col, text_col, host_col), "lines")
    frequent = written(frequent_lines(rows, min_docs, max_share), "frequent")
    gone = _removed(rows, frequent).groupBy("row").agg(F.sum("n").alias("gone"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = rows.drop("lines", "host", "same").join(gone, "row", "left").withColumns({"n_left": left, "base_failed": base})
    depleted = (F.col("n_left") < MIN_WORDS) | (100 * F.col("n_left") < min_left * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row", "gone")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS,
            max_share: int = MAX_SHARE, min_left: int = MIN_LEFT) -> DataFrame:
    """``docs`` without rejected documents, and their texts without the removed lines.

    What is removed depends on host and text alone, so removals are joined by both
    (salted: a text may fill a third of the rows).
    """
    rows = written(measured(docs, id_col, text_col, host_col), "lines")
    frequent = written(frequent_lines(rows, min_docs, max_share), "frequent")
    distinct = rows.groupBy("host", "same").agg(F.min("row").alias("row"), F.min("n_words").alias("n_words"), F.min("n_repeat_words").alias("n_repeat"))
    gone = _removed(rows, frequent).groupBy("row").agg(F.sum("n").alias("gone"), F.collect_set("h").alias("hot"))
    each = distinct.join(gone, "row", "left").withColumn("left", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    good = each.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat") <= MAX_REPEAT * F.col("n_words"))
                      & (F.col("left") >= MIN_WORDS) & (100 * F.col("left") >= min_left * F.col("n_words")))
    good = written(good.select(F.struct("host", "same").alias("key"), "hot"), "good")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    keyed = plain.withColumn("key", F.struct(_host(names[docs.columns.index(host_col)]).alias("host"), _text_hash(text).alias("same")))
    keyed = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    joined = keyed.join(good.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["key", "salt"])

    @F.pandas_udf("string")
    def strip(texts, hot):
        return texts.combine(hot, lambda t, h: t if h is None or not len(h) else "\n".join(
            x for x in t.split("\n") if line_hash(x.encode()) not in set(h.tolist())))

    out = joined.withColumn(text, F.when(F.col("hot").isNull(), F.col(text)).otherwise(strip(F.col(text), F.col("hot"))))
    return out.select(*names).toDF(*docs.columns)
