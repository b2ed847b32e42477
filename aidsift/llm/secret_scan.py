"""Secrets and who owns them (operator 8).

Base kinds are patterns; their spans always stay. ``entropy`` is a further
candidate: a run of 20 or more token characters with letters and digits and
at least ``MIN_ENTROPY`` bits a character, outside the base spans.

Candidate values are hashed, and over the whole corpus the distinct owners
and repositories of each hash are counted. A value of more than ``max_owners``
owners is a widely copied example; one of fewer is owner-specific and
``live``. An entropy candidate becomes a span only if it is live. Counts are
exact: (hash, owner, repository) is made distinct before it is counted, so a
value that a third of the rows hold is a few rows per task.

A null text is empty. A null owner or repository is a name of its own.
Repeated rows are scanned each on its own, and count once as owners. Spans
are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .wordhash import CHUNK, flat

#: The base kinds, in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # the runs that HEX finds with 24 or more
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_ENTROPY = 3.5
MAX_OWNERS = 2

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base kinds."""
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX_LONG.finditer(text)]
    return out


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _extra(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    out = []
    for m in RUN.finditer(text):
        v = m[0]
        if any(s < m.end() and m.start() < e for s, e, _, _ in base):
            continue
        digits, letters = sum(c.isdigit() for c in v), sum(c.isalpha() for c in v)
        if digits >= 3 and letters >= 3 and entropy(v) >= MIN_ENTROPY:
            out.append((m.start(), m.end(), "entropy", v))
    return out


def long_runs(data: np.ndarray, off: np.ndarray, size: int = 20, chunk: int = CHUNK) -> np.ndarray:
    """Whether each text has a run of ``size`` token characters (bytes). ``chunk`` places are looked at
    at a time, so the memory beside the texts does not grow with them."""
    out = np.zeros(len(off) - 1, dtype=bool)
    for lo in range(int(off[0]), int(off[-1]), chunk):
        run, have = _TOKEN[data[lo:min(lo + chunk + size - 1, int(off[-1]))]], 1
        while have < size and len(run):
            step = min(have, size - have)
            run = run[:-step] & run[step:] if len(run) > step else run[:0]
            have += step
        out[np.searchsorted(off, lo + np.flatnonzero(run), side="right") - 1] = True
    return out


def text_hash(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.sha2(text.cast("string").cast("binary"), 256), 1, 32)


SPANS = "array<struct<start:long,end:long,kind:string,h:string>>"


def scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """A row per document with its candidate spans; ``h`` is the value's hash."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("h", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(3), []
            data, off = flat(texts)
            for text, runs in zip(texts, long_runs(data, off)):
                text = text.as_py() or ""
                low = text.lower()
                found = []
                if runs or any(w in low for w in WORDS):
                    found = base_spans(text)
                    found += _extra(text, found) if runs else []
                found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                out.append([{"start": s, "end": e, "kind": k, "h": hashlib.sha256(v.encode()).hexdigest()[:32]} for s, e, k, v in found])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 2, 4)], pa.array(out, kind)],
                                             names=["doc_id", "owner", "repo", "text_hash", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                       F.col(repo_col).cast("string").alias("repo"), F.col(text_col).cast("string").alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id long, owner string, repo string, text_hash string, found {SPANS}")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str = "lang", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``spans`` (array of start, end, kind, live) of each row, by start
    and then kind. A repository is an owner's ``repo_col``."""
    rows = written(scanned(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s"))
    named = each.select(F.col("s.h").alias("h"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo")).distinct()
    owners = named.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    owners = written(owners.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")), "owners")
    live = (F.col("owners") <= max_owners).alias("live")
    spans = (each.select("row", "s", F.col("s.h").alias("h")).join(owners, "h")
             .select("row", F.struct("s.start", "s.end", "s.kind", live, "owners", "repos").alias("s"))
             .where("s.kind != 'entropy' or s.live"))
    order = F.expr("array_sort(collect_list(s), (x, y) -> case when x.start < y.start then -1 when x.start > y.start then 1 "
                   "when array_position(array('assign','access','hex','entropy'), x.kind) < array_position(array('assign','access','hex','entropy'), y.kind) "
                   "then -1 when x.kind = y.kind then 0 else 1 end)")
    spans = spans.groupBy("row").agg(order.alias("spans"))
    empty = F.array().cast("array<struct<start:long,end:long,kind:string,live:boolean,owners:long,repos:long>>")
    return rows.select("row", "doc_id", "text_hash").join(spans, "row", "left").select("doc_id", "text_hash", F.coalesce("spans", empty).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", placeholder: str = "<SECRET>", **options) -> DataFrame:
    """``docs`` with the live spans of its texts replaced; widely copied examples stay.
    Spans are joined by id, null or not, and a hash of the text, so rows that share an id each get those of their own text."""
    found = (find_secrets(docs, id_col, text_col, **options)
             .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.explode("spans").alias("s")).where("s.live")
             .groupBy("_id", "_hash").agg(F.sort_array(F.collect_set(F.struct("s.start", "s.end"))).alias("_spans")))
    found = written(found, "live")
    # columns under names of our own, so that none clashes and none needs quoting
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, text = docs.toDF(*names), names[docs.columns.index(text_col)]
    joined = plain.join(found, F.col(names[docs.columns.index(id_col)]).cast("long").eqNullSafe(found["_id"]) & (text_hash(F.col(text)) == found["_hash"]), "left")
    # spans may overlap: each takes what the ones before it have left
    step = F.aggregate(
        F.col("_spans"), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(
            F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(placeholder)).alias("out"),
            s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text))))
    redone = joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(step))
    return redone.select(*names).toDF(*docs.columns)
