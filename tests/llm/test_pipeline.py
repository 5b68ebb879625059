"""The pipeline against a plain version of its stages."""

import hashlib
import pickle
import random

import public_tokenizers as P
import pyarrow as pa
from pyspark import cloudpickle
from tokenizers import Tokenizer

import corpus_pipeline
from trisearch.llm import bpe, common, jaccard_join, queries, toxicity


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_pipeline(spark, tmp_path):
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choice(["ba", "do", "ki", "lu", "mer", "non"]) + rnd.choice(["pa", "ri", "so", "tu", ""]) + str(rnd.randrange(40)) for _ in range(n))
    docs, labels, items = [], [], [(i, text(20)) for i in range(3)]
    for i in range(200):
        body = text(40)
        if i % 4 == 0:
            body += " idiot scum loser idiot"
        docs.append((i, body))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(300, docs[1][1]), (301, docs[2][1] + " more"), (302, text(10) + " " + items[0][1] + " " + text(9)), (303, None), (304, "")]
    full = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    write(spark, tmp_path, documents=(full, "doc_id long, text string, lang string, source string, n_chars long"), labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(items, "item_id long, text string"))

    frame, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    model = toxicity.train(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = model.score([toxicity.words_of(t or "") for _, t in docs])
    toxic = {i for (i, _), s in zip(docs, scores, strict=True) if s >= 0.3}
    assert sum(i % 4 == 0 for i in toxic) > 45 and sum(i % 4 != 0 for i in toxic) < 5
    expected = {i: t or "" for i, t in docs if i not in toxic and not (i == 300 and 1 not in toxic) and not (i == 301 and 2 not in toxic) and i != 302}

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == expected.keys()
    for i, t in expected.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(bytes(got[i].ids)).hexdigest()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]


def test_operators_keep_no_memory_of_each_other(spark, monkeypatch):
    """A Python worker that has encoded words scores or compares texts later."""
    docs = spark.createDataFrame([(1, "ba do ki")], "doc_id long, text string")
    made = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: made.append(f) or self)
    monkeypatch.setattr(common, "_loaded", {})

    def run(batch):
        list(made[-1](iter([pa.RecordBatch.from_pydict(batch)])))

    batch = {"doc_id": [1], "text": ["ba do ki"]}
    bpe.round_trip(docs, P.path("byte_bpe_50k.json"))
    run(batch)
    run(batch)
    assert list(common._loaded) and list(common._loaded)[0][0] == "bpe"  # its own stays from task to task
    toxicity.keep_ordinary(docs, toxicity.Classifier(None, None, 0.0, 0.0))
    run(batch)
    assert not common._loaded
    common.once(("other", 1), object)
    jaccard_join._scan(docs, 5, 14, 63)
    run(batch | {"text_hash": [1]})
    assert not common._loaded
    # As Spark sends it: the worker's own module is meant.
    common.once(("other", 1), object)
    assert list(pickle.loads(cloudpickle.dumps(common.alone(lambda batches: iter(batches))))([2])) == [2]
    assert not common._loaded


def test_training_starts_no_other_workers(spark, monkeypatch):
    """Rows of a Python list go through workers apart from those of batches, and an executor has both."""
    docs = spark.createDataFrame([(i, "ba do scum" if i % 2 else "ba do ki") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def parallelize(*args, **kwargs):
        raise AssertionError("rows of a list")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    found = toxicity.train(docs, labels)
    ordinary, toxic = found.score([["ba", "ki"], ["ba", "scum"]])
    assert found.ratio and ordinary < toxic
