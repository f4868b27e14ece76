"""The pipeline against its stages applied by plain code, and the registered queries on the smallest tables."""

import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_small import brute_counts, shingle_set  # noqa: E402

from cadenza.llm import queries, quality, secret_scan, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages(spark, sf_dir, raw):
    docs = {r.doc_id: r.text for r in raw.collect()}
    model = toxicity.train(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = {d: t for d, t in docs.items() if model.score(t) < 0.5}
    after = pipeline.drop_toxic(spark, raw, sf_dir).cache()
    assert after.columns == raw.columns and {r.doc_id for r in after.collect()} == set(docs)

    kept = {r.doc_id for r in quality.assess(after).where("kept").collect()}
    assert all(not brute_counts(docs[d])[5] for d in kept)
    after = pipeline.apply_rules(spark, after, sf_dir).cache()
    assert after.columns == raw.columns and {r.doc_id for r in after.collect()} == kept

    sets, alive = {d: shingle_set(docs[d]) for d in sorted(kept)}, {}
    for d, s in sets.items():
        alive[d] = d
        for e in [e for e in sets if e < d]:
            if 100 * len(s & sets[e]) >= 80 * len(s | sets[e]) > 0:
                old, new = max(alive[d], alive[e]), min(alive[d], alive[e])
                alive = {k: new if v == old else v for k, v in alive.items()}
    kept = {d for d, first in alive.items() if d == first}
    after = pipeline.drop_near_copies(spark, after, sf_dir).cache()
    assert after.columns == raw.columns and {r.doc_id for r in after.collect()} == kept

    after = pipeline.redact_secrets(spark, after, sf_dir).cache()
    assert after.columns == raw.columns
    words = secret_scan.automaton()
    for r in after.collect():
        assert not secret_scan.find(r.text, words)
        assert (r.text == docs[r.doc_id]) == (not secret_scan.find(docs[r.doc_id], words))
        assert r.n_chars == len(r.text)
    packed = pipeline.pack_sequences(spark, after, sf_dir).toPandas()
    assert set(packed["doc_id"]) == kept and packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_run(spark, sf_dir):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "secret_scan", "best_fit_packing"]
    assert pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, sf_dir, name):
    table = {"op7": "embeddings", "op8": "pages"}.get(name.split("_")[0], "documents")
    df, key = queries.QUERIES[name](spark, sf_dir), {"embeddings": "vec_id", "pages": "page_id"}.get(table, "doc_id")
    assert df.select(key).distinct().count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    told = lambda df: Counter(tuple(None if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and told(got) == told(want)


def test_names():
    assert [n for n in queries.QUERIES if not re.fullmatch(r"op\d+_\w+", n)] == [] and len(queries.QUERIES) == 10
