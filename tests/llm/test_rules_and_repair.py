"""Operators 11 to 13 against SQL and brute force, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aidsift.llm import conversation, importance, line_rules, queries
from aidsift.sources.tables import TABLES

from .test_llm import documents, prose

SF = "/root/testdata/sf0.001"


def by_sql(name, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    return [c[0] for c in cur.description], cur.fetchall()


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_quality_rules"])
def test_against_sql(spark, name):
    columns, rows = by_sql(name)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


# --- 11 ---

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    w = WORDS.findall((text or "").encode().translate(importance.LETTERS))
    return len(w), sorted(zlib.crc32(f) % importance.BUCKETS for f in w + [a + b" " + b for a, b in zip(w, w[1:])])


def test_composed_crcs():
    r = random.Random(1)
    words = [bytes(r.choices(range(97, 123), k=n)) for n in (1, 2, 3, 9, 63, 64, 65, 66, 67, 500)]
    for a, b in itertools.product(words, words):
        got = importance.compose(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([zlib.crc32(b)], dtype=np.uint32), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b" " + b)


@pytest.mark.parametrize("known", [0, 3, 10_000])
def test_features_do_not_depend_on_the_dictionary(known, monkeypatch):
    monkeypatch.setattr(importance, "SEGMENT", 200)
    texts = ["", "one", "É été-Tö 9x\x00y", prose(500, 3), "a" * 1000 + " b " + "c" * 300, "  ", prose(20, 4), "cat at a catcat"]
    words = sorted({w for t in texts for w in t.encode().translate(importance.LETTERS).split() if len(w) <= 64})[:known]
    n, rows, found = importance.features([t.encode() for t in texts], importance.Dictionary(words))
    for i, t in enumerate(texts):
        assert (n[i], sorted(found[rows == i].tolist())) == buckets(t)


def test_resample_odd_rows(spark):
    rows = [(None, prose(40, 1)), (1, None), (2, ""), (3, "..."), (4, prose(30, 2)), (4, prose(30, 2)), (5, prose(30_000, 3)), (6, prose(19, 4)), (7, prose(20, 5))]
    target = spark.createDataFrame([(1, prose(50, 2)), (2, None)], "item_id long, text string")
    got = importance.resample(documents(spark, rows), target, percent=50, max_words=5).collect()
    assert len(got) == len(rows)
    enough = sorted((-r["score"], r["doc_id"] is None, r["doc_id"]) for r in got if r["n_words"] >= 20)
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"]) for r in got if r["rank"])
    assert drawn == [(i + 1, *x) for i, x in enumerate(enough[:len(enough) // 2])]
    whole = {(r["doc_id"], r["n_features"], r["n_words"]) for r in got}
    assert whole == {(i, len(buckets(t)[1]), buckets(t)[0]) for i, t in rows}
    again = importance.resample(documents(spark, rows), target, percent=50).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))  # a larger dictionary changes nothing
    assert importance.resample(documents(spark, []), target).collect() == []
    assert len(importance.resample(documents(spark, rows), target.limit(0)).collect()) == len(rows)


# --- 12 ---

def test_lines_of_a_host(spark):
    notice = "All rights  of this page are reserved by the host"
    rows = [(i, f"{prose(30, i)}\n{notice if i % 2 else notice.upper()}\n") for i in range(0, 36, 3)]   # 12 documents of src0
    rows += [(100 + i, f"{prose(15, 500)}\n{notice}") for i in range(2, 200, 3)]                          # one text, 66 times
    rows += [(3000, f"too few words beside it\n{notice}")]                                                # depleted, src0
    rows += [(None, None), (1, ""), (4, " \n\t"), (7, "one two"), (10, prose(30_000, 9)), (13, "a b c d e a b c d e f g h")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in line_rules.judge(docs, min_docs=5, max_share=20).collect()}
    size = len(notice.split())
    for i in range(0, 36, 3):
        assert got[i]["n_left"] == got[i]["n_words"] - size and got[i]["kept"]
    assert got[102]["n_left"] == 15 and got[102]["kept"]  # copies are one document: their own line stays
    assert (got[3000]["n_left"], got[3000]["base_failed"], got[3000]["kept"]) == (5, False, False)
    assert got[None]["base_failed"] and got[1]["n_words"] == 0 and not got[1]["kept"] and got[4]["base_failed"]
    assert got[13]["n_repeat_words"] == 10 and got[13]["base_failed"]
    assert got[10]["n_words"] == 30_000
    assert len(got) == len({i for i, _ in rows})
    assert line_rules.judge(documents(spark, [])).collect() == []


def test_cleaned_texts(spark):
    notice = "All rights of this page are reserved by the host"
    good = [(i, f"{prose(30, i)}\n{notice}\nend {i}") for i in range(0, 36, 3)] + [(60, prose(30, 0))] * 2
    rows = good + [(51, f"{notice}\nfew words"), (54, None), (57, "short")]
    docs = documents(spark, rows)
    got = sorted((r["doc_id"], r["text"]) for r in line_rules.cleaned(docs, min_docs=5, max_share=20).collect())
    assert got == sorted((i, t.replace(notice + "\n", "")) for i, t in good)
    assert line_rules.cleaned(documents(spark, [])).columns == docs.columns


def test_salted_host_and_line(spark):
    """One line and one host in every row."""
    rows = [(3 * i, f"{prose(12, i)}\nthe same line") for i in range(400)]
    got = line_rules.judge(documents(spark, rows)).collect()
    assert len(got) == 400 and all(r["n_left"] == 12 and r["kept"] for r in got)


# --- 13 ---

def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All repairs by exhaustive search: (cost, audit, repaired lines) of the audit-least cheapest."""
    marks, best = faults(rows), None
    pattern = re.compile(r"(s?(ua)+)?")

    def go(i, cost, audit, lines, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if pattern.fullmatch("".join(x[:1] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
        else:
            role, text = rows[i]
            go(i + 1, cost + 3, audit + "D", lines, 0)
            if marks[i] not in ("b", "d"):
                extra = marks[i] == "t"
                go(i + 1, cost + extra, audit + "K", lines + (f"{role}:{text}",), 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + extra, audit + "R", lines + (f"{new}:{text}",), 0)
        if inserted < 2:
            for new in ("user", "assistant"):
                go(i, cost + 2, audit + "I", lines + (f"{new}:",), inserted + 1)

    go(0, 0, "", (), 0)
    return best


def symbols_of(rows):
    return bytes({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (4 if m in ("b", "d") else 8 if m == "t" else 0) for (role, _), m in zip(rows, faults(rows)))


def random_rows(r, n):
    return [(r.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), r.choice(["", " ", "A.", "B!", "c", "d?", f"{r.random()}."])) for _ in range(n)]


def test_hirschberg_and_blocks():
    r = random.Random(5)
    for trial in range(250):
        rows = random_rows(r, r.randrange(1, 5))
        symbols = symbols_of(rows)
        want = cheapest(rows)
        for block in (1, 2, 5):
            parts = [symbols[i:i + block] for i in range(0, len(symbols), block)]
            path, cost, roles = conversation.crossings([conversation.transfer(p) for p in parts])
            edits = [e for p, a, b in zip(parts, path, path[1:]) for e in conversation.hirschberg(p, a, b)]
            audit = "".join("I" * len(x) + letter for letter, x, _ in edits) + "I" * len(roles)
            assert (cost, audit) == want[:2], (rows, block)


def audits(spark, rows):
    original = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string, place long, block int")
    return {r["conv_id"]: r for r in conversation.audited(original, original).collect()}


@pytest.mark.parametrize("block", [2, 4096])
def test_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(conversation, "BLOCK", block)
    r, rows, want = random.Random(block), [], {}
    for c in [None, *range(25)]:
        turns = random_rows(r, r.randrange(1, 5))
        want[c] = (faults(turns), cheapest(turns))
        rows += [(c, 2 * i if i or c != 3 else None, role, text, "x", 1, 2) for i, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    got = audits(spark, rows)
    assert set(got) == set(want)
    for c, (marks, (cost, audit, lines)) in want.items():
        g = got[c]
        assert (g["cost"], g["audit"]) == (cost, audit)
        assert (g["blank"], g["duplicate"], g["truncated"]) == tuple(marks.count(x) for x in "bdt")
        assert g["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_odd_conversations(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, None, None, None), (2, 5, "user", long), (2, 6, "assistant", long), (2, 6, "assistant", long), (3, None, "user", "a."), (3, 9, "assistant", "b.")]
    got = audits(spark, [(*r, None, None, None) for r in rows])
    assert (got[1]["blank"], got[1]["cost"], got[1]["audit"], got[1]["gaps"]) == (1, 3, "D", 0)
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[2]["duplicate"], got[2]["audit"], got[2]["gaps"], got[2]["illegal"]) == (1, "KKD", 0, 1)
    assert got[2]["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert (got[3]["gaps"], got[3]["audit"], got[3]["cost"]) == (0, "KK", 0)
    assert audits(spark, []) == {}
    original = spark.createDataFrame([(7, 1, "user", "x.")], "conv_id long, turn long, role string, text string")
    empty = conversation.audited(original, original.limit(0)).collect()
    assert tuple(empty[0]) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = conversation.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        want += [(c, t, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_every_conversation_is_returned(spark):
    got = queries.QUERIES["op13_conversation_repair"](spark, SF)
    ids = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct()
    assert got.count() == ids.count() == got.select("conv_id").distinct().count()
    assert got.where(~F.col("audit").rlike("^[KRDI]*$") | F.col("cost").isNull()).isEmpty()


def test_toxicity_places_words_only_where_needed(monkeypatch):
    """A text without matched words or glued ones is not searched for the places of its words; others score as before."""
    from aidsift.llm import toxicity as X

    class Words:
        findall, places = X.WORD.findall, 0

        def finditer(self, text):
            self.places += 1
            return real.finditer(text)

    real, words = X.WORD, Words()
    monkeypatch.setattr(X, "WORD", words)
    matcher = X.Matcher(["horrible"], ["zqx"])
    assert X.features(matcher, "a calm text of words") == X.features(matcher, "") == [0.0] * X.FEATURES and words.places == 0
    assert [sum(x > 0 for x in X.features(matcher, t)[:4]) for t in ("so horrible", "so horible", "ho.rrible it is", "zqxy", "no-one")] == [1, 1, 1, 1, 0]
    assert words.places == 5
