from __future__ import annotations

import os
import subprocess
import sys
from statistics import NormalDist

import numpy as np

import corpus_pipeline
from kmerlake.llm import lang_id
from kmerlake.llm.common import staged
from kmerlake.llm.mixing import Mix
from tests.llm.data import documents, edge_rows, frame
from tests.llm.test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"
NAMES = ["language_id", "exact_dedup", "near_duplicates", "mix_sources", "encode_pieces"]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


def check(spark, docs):
    """Each stage against what its operator says of all that the stage before kept."""
    tables = [docs]
    for name, f in corpus_pipeline.STAGES:
        tables.append(staged(f(spark, tables[-1], ""), name))
    keys = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    start, known, exact, near, mixed, ids = tables
    for t in tables[1:-1]:
        assert t.columns == docs.columns
    protos = lang_id.fit(start.filter(lang_id.in_training(start["doc_id"])))
    found = lang_id.predict(start.select("doc_id", "text"), protos).collect()
    assert keys(known) == sorted(str(r["doc_id"]) for r in found if r["lang_pred"] != "und" and r["score"] > NormalDist(0, 512**-0.5).inv_cdf(0.99 ** (1 / len(protos))))
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    last = {}
    for r in known.collect():
        if r["doc_id"] is not None:
            t = (r["text"] or "").translate(low)
            last[t] = max(last.get(t, -1), r["doc_id"])
    assert set(keys(exact)) - {"None"} == {str(k) for k in last.values()}
    rows = [tuple(r)[:2] for r in exact.select("doc_id", "text").collect()]
    want = near_brute(rows)
    assert keys(near) == sorted(str(r[0]) for r in rows if r[0] is None or want[r[0]][2])
    copies = {}
    for r in Mix(near).taken().collect():
        copies[str(r["doc_id"])] = copies.get(str(r["doc_id"]), 0) + r["copies"]
    assert keys(mixed) == sorted(k for k, n in copies.items() for _ in range(n))
    assert keys(ids) == keys(mixed) and ids.filter("not lossless").isEmpty()


def trigram_vector(text):
    """The text's profile, letter by letter; only the letters' random vectors are the operator's."""
    marked = [0]
    for c in text.lower():
        slot = 0 if not c.isalpha() else ord(c) if ord(c) < lang_id.DIRECT else lang_id.DIRECT + ord(c) % lang_id.POOLED
        if slot or marked[-1]:
            marked.append(slot)
    if marked[-1]:
        marked.append(0)
    v = lang_id._letters()[1].astype(float)
    return sum((np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(marked, marked[1:], marked[2:])), np.zeros(lang_id.DIMS))


def test_language_id_rejects_what_resembles_no_language(spark):
    """Rows worked out without the operator: of texts in scripts that no profile knows nearly all go, of the profiles' own none."""
    said = {"en": "the cat sat on the mat and thought of the other cat", "fr": "le chat est sur la table avec son ami le chien"}
    rows = [(i, said[k], k, "a", 0) for i, k in enumerate(["en", "fr"] * 10)]
    odd = ["", None, "123 !", "\u4f60\u597d\u4e16\u754c", "\u0431\u044b\u0441\u0442\u0440\u043e", "zqx", "\u03b1\u03b2\u03b3 \u03b4\u03b5", "x"]
    rows += [(100 + i, t, None, "a", 0) for i, t in enumerate(odd)]
    profiles = [trigram_vector(t) for t in said.values()]
    strange = np.random.default_rng(3)
    rows += [(200 + i, " ".join("".join(chr(c) for c in strange.integers(0x430, 0x44F, strange.integers(4, 9))) for _ in range(30)), "ru", "a", 0) for i in range(100)]
    rows = [r if r[0] < 200 else (*r[:2], None, *r[3:]) for r in rows]
    unit = lambda v: v / max(1e-9, np.linalg.norm(v))
    cosines = {r[0]: [unit(trigram_vector(r[1] or "")) @ unit(p) for p in profiles] for r in rows}
    least = NormalDist(0, 512**-0.5).inv_cdf(0.99**0.5)
    want = sorted(k for k, c in cosines.items() if max(c) > least)
    assert not {100, 101, 102} & set(want) and set(range(20)) <= set(want) and len([k for k in want if k >= 200]) <= 4
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, frame(spark, rows), "").collect()) == want


def test_made_up_documents(spark):
    check(spark, frame(spark, documents(n=120) + edge_rows(), True))


def test_copies_go_by_row(spark):
    """Rows without a key, repeated rows, and a key of several texts."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "no key", "en", "a", 1), (None, "NO KEY", "en", "b", 2), (None, "no key", "en", "a", 1), (None, "has one", "en", "a", 3), (5, "Has one", "en", "a", 4)]
    rows += [(6, "twice", "en", "a", 5), (6, "twice", "en", "a", 5), (7, "a copy", "en", "a", 6), (8, "A copy", "en", "a", 7), (7, "its own text", "en", "a", 8)]
    rows += [(9, long, "en", "a", 9), (None, long + " x", "en", "a", 10), (None, long + " y", "en", "a", 11), (10, long + " z", "en", "a", 12), (10, "another text of ten", "en", "a", 13), (-3, "less than none", "en", "a", 14)]
    exact = staged(corpus_pipeline.exact_dedup(spark, frame(spark, rows, True), ""), "exact")
    told = lambda df: sorted((str(r["doc_id"]), r["text"].lower()) for r in df.collect())
    want = [("None", "no key"), ("5", "has one"), ("6", "twice"), ("8", "a copy"), ("7", "its own text"), ("10", "another text of ten"), ("-3", "less than none"), ("9", long)]
    assert told(exact) == sorted([*want, ("None", long + " x"), ("None", long + " y"), ("10", long + " z")])
    near = corpus_pipeline.near_duplicates(spark, exact, "")
    assert near.columns == exact.columns and told(near) == sorted(want)


def test_driver_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spark, docs)
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_empty_table(spark):
    docs = frame(spark, [])
    for name, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, ""), name)
    assert docs.count() == 0



def test_the_rest_works_without_this(tmp_path):
    """With these folders and the pipeline gone, the entry still imports and has the engine's queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run(["cp", "-r", f"{root}/kmerlake", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "kmerlake/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and q.keys() == e.oracle_sql().keys() and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
