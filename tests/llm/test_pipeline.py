import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lotline.llm import pii, queries, toxicity

from . import data
from .test_mixing import water
from .test_pii import brute, cut

SMALL = "/root/testdata/sf0.001"


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.lower(text))
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def test_stages(spark):
    """Each stage's rows against what a plain version keeps of the rows of the stage before."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()
    told = dict.fromkeys(n for n, _ in corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, docs, SMALL), "test")
        assert after.columns == columns
        kept = {r["doc_id"]: r for r in after.collect()}
        assert len(kept) == after.count()
        if name == "toxicity":
            score = {r["doc_id"]: r["toxicity_score"] for r in toxicity.scored(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
            want = {i for i in rows if score[i] < 0.5}
        elif name == "near_duplicates":
            ids = sorted(rows)
            of, sets = data.groups([rows[i]["text"] for i in ids])
            want = {i for k, i in enumerate(ids) if of[k] == k or not sets[k]}
        elif name == "decontamination":
            items = [windows(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            long = set().union(*({w for w in x if len(w) == 10} for x in items))
            short = {w for x in items for w in x if len(w) < 10}
            text = {i: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.lower(r["text"]))) + " " for i, r in rows.items()}
            want = {i for i, r in rows.items() if not windows(r["text"]) & long and not any(f" {' '.join(w)} " in text[i] for w in short)}
        else:
            spans = {r["doc_id"]: r["spans"] for r in pii.extract(docs).collect()}
            want = set(rows)
            for i, r in kept.items():
                once = cut(rows[i]["text"] or "", spans[i].split(","))
                assert (r["text"] or "") == (cut(once, brute(once)) if spans[i] else once)
        told[name] = len(rows) - len(kept)
        assert kept.keys() == want, name
        changed = {"text", "n_chars"} if name == "personal_data" else set()
        assert all(kept[i][c] == rows[i][c] for i in kept for c in columns if c not in changed)
        docs, rows = after, kept
    assert told["toxicity"] and told["near_duplicates"] and told["decontamination"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.columns == [*columns, "copies"]
    got = {r["doc_id"]: r for r in last.collect()}
    size = {i: len((r["text"] or "").split()) for i, r in rows.items()}
    per = {}
    for i, r in rows.items():
        per[r["source"]] = per.get(r["source"], 0) + size[i]
    target, taken = water(per), dict.fromkeys(per, 0)
    for i, r in got.items():
        assert 1 <= r["copies"] <= 3 and all(r[c] == rows[i][c] for c in columns)
        taken[r["source"]] += size[i] * r["copies"]
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i, r in rows.items() if r["source"] == s) for s in per)


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_mixing", "op6_jaccard", "op7_warc", "op9_decontamination", "op10_chat", "op11_suffix_dedup", "op12_filter_audit", "op13_kd_cluster"])
def test_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
