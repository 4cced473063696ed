"""Filter interaction audit against brute force; scanning of odd buffers; hash clashes; nulls, copies, empty tables, clashing names."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from plumbline.llm import filter_audit, shared

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, mask int, part string, n long, digest string"
LABELS = "doc_id long, quality int, toxic int, part string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Every order walked document by document."""
    fails, parts = [], {}
    for doc_id, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs)
        marks = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        fails.append((source or "", {k for k, v in marks.items() if v}, any(i == doc_id and q == 1 for i, q, _ in labels if i is not None), any(i == doc_id and x == 1 for i, _, x in labels if i is not None)))
        parts[source or ""] = True
    out, shapley = [], Counter()
    for part in parts:
        own = [x[1:] for x in fails if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                removed, stay = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shapley[part, f] += len(removed)
                out.append([part, "".join(order), step + 1, len(stay), len(removed), sum(f in x[0] for x in own) - len(removed), sum(x[0] == {f} for x in own), sum(x[1] for x in removed), sum(x[2] for x in removed)])
                left = stay
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def made(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcXé") for _ in range(rng.randint(1, 12)))
    texts = [None, "", " \n\t", "one", "#", "É" * 2000, "x" * 5000 + " " + "x" * 5000, "a b " * 150, "aB " * 300] + [" ".join(word() for _ in range(rng.randint(1, 400))) + rng.choice(["", "", " 5%"]) for _ in range(40)]
    docs = [(rng.choice([k, k, k % 7, None]), rng.choice(texts), rng.choice(["s", "t", "", None])) for k in range(160)] + [(5, "same text", "s")] * 9
    labels = [(k % 60, rng.randint(0, 1), rng.choice([0, 1, None])) for k in range(80)] + [(None, 1, 1)]
    df = spark.createDataFrame([(i, t, "en", s, 3, "p", 1, "d") for i, t, s in docs], DOCS).repartition(5)
    got = filter_audit.audit(df, spark.createDataFrame([(*r, "p") for r in labels], LABELS))
    assert made(got) == brute(docs, labels)


def test_audit_of_nothing(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, labels).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None, None, 0, "", 0, "")], DOCS), labels)
    assert made(one) == brute([(1, None, None)], []) and len(made(one)) == 600


@pytest.mark.parametrize("bits", [44, 3, 0])
def test_distinct_words_with_clashing_hashes(monkeypatch, bits):
    """With few bits most words of a document share a hash; the counts stay right."""
    monkeypatch.setattr(filter_audit, "HASH_BITS", bits) if bits else monkeypatch.setattr(filter_audit, "word_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    rng = random.Random(bits)
    texts = ["".join(rng.choice("ab\0 \né") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", "w" * 3000 + " " + "w" * 2999 + "v " + "w" * 3000, "12345678 123456789 12345678\0"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = filter_audit.scan_step(data, offsets)
    assert got["n_distinct"].tolist() == [len(set(re.findall(r"[^\x20\x09-\x0D]+", t))) for t in texts]
    assert got["n_words"].tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    assert got["n_points"].tolist() == list(map(len, texts))


def test_word_hash_reads_its_word_alone():
    data = np.frombuffer(b"abcdefghij abcdefghij abcdefghiX", np.uint8)
    start, end, _ = shared.words(data, np.array([0, len(data)]))
    h = filter_audit.word_hash(data, start, end)
    assert h[0] == h[1] != h[2]
    assert filter_audit.same_words(data, start, end, np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_query_and_sql(spark, folder):
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    rel = c.sql(filter_audit.SQL)
    assert rel.columns == COLUMNS
    assert made(filter_audit.op13_filter_audit(spark, folder)) == sorted(rel.fetchall())
