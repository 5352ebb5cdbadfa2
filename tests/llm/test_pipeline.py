import inspect
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from tillstream.llm import bpe, queries  # noqa: E402
from tillstream.llm import toxicity as T  # noqa: E402

from test_contamination import brute as brute_windows  # noqa: E402
from test_simhash import brute_fingerprint, brute_groups  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_operators_swallow_no_import_errors():
    folder = Path(queries.__file__).parent
    for source in [*folder.glob("*.py"), Path(corpus_pipeline.__file__)]:
        assert "except ImportError" not in source.read_text()


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "pages"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    result = database.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    expected = sorted(result.fetchall(), key=repr)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == expected


def brute_lines(docs, ratio=0.02, least=3):
    pages = {}
    for d in docs:
        if d["text"] is not None:
            pages.setdefault(d["source"], set()).add(d["text"])
    drop = {}
    for host, texts in pages.items():
        counts = {}
        for text in texts:
            for line in {x.strip(" ") for x in text.split("\n")} - {""}:
                counts[line] = counts.get(line, 0) + 1
        drop[host] = {x for x, n in counts.items() if n >= least and n > ratio * len(texts)}
    return [d | {"text": None if d["text"] is None else "\n".join(
        x for x in d["text"].split("\n") if x.strip(" ") not in drop[d["source"]])} for d in docs]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
def test_pipeline_equals_its_stages_one_by_one(spark):
    """Against plain Python for every stage but the trained score, which is the operator's own."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [r.asDict() for r in table.collect()]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = T.fit(table, labels)

    def score(text):
        import numpy as np
        words = sorted(set(T.words_of(text)))
        values = model.decide(words).tolist() if words else []
        return float(model.score(np.array([model.document(values)]))[0])

    docs = [d for d in docs if score(d["text"]) < 0.5]
    docs = brute_lines(docs)
    roots = brute_groups([brute_fingerprint(d["text"]) for d in docs])
    first = {}
    for d, root in zip(docs, roots):
        first[root] = min(first.get(root, d["doc_id"]), d["doc_id"])
    docs = [d for d, root in zip(docs, roots) if d["doc_id"] == first[root]]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(
        f"{SMALL}/benchmark.parquet").collect()]

    def dirty(text):
        n, n_hit, _ = brute_windows(text, items)
        return n_hit > 0 and 20 * n_hit >= n

    # Comparing all windows of all pairs is slow, so documents without a shared 4-gram are skipped.
    runs = lambda t: {tuple(w[i:i + 4]) for w in [t.lower().split()] for i in range(len(w) - 3)}
    known = set().union(*(runs(t) for _, t in items))
    docs = [d for d in docs if not (runs(d["text"] or "") & known and dirty(d["text"]))]
    vocabulary = bpe.load_vocabulary(queries.tokenizer_path())
    codec = bpe.OpenCodec(vocabulary, bpe.compile_lexicon({}))
    expected = sorted((d["doc_id"], len(ids) // 4) for d, ids in zip(
        docs, codec.encode([d["text"] for d in docs])))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == expected


def test_stages_keep_columns_and_survive_odd_rows(spark, odd_documents, write):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some benchmark item")], "item_id long, text string")
    folder = write(documents=odd_documents, labels=labels, benchmark=bench)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd_documents.columns
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_tables(spark, documents, write):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    empty = documents((1, "x")).limit(0)
    folder = write(documents=empty, labels=labels, benchmark=bench, pages=pages)
    assert corpus_pipeline.run(spark, folder).count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() == 0, name


def test_functions_take_spark_docs_and_folder():
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
