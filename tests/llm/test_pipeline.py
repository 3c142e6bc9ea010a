import corpus_pipeline as pipe
import public_tokenizers
from eventide.llm import bpe, pii, quality
from eventide.llm.common import table
from tests.llm import brute
from tests.llm.conftest import SF


def test_stages_in_order():
    assert [n for n, _ in pipe.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE encoding and decoding"]


def test_whole_pipeline(spark):
    """The rows of run(), from plain versions of the stages."""
    docs = table(spark, SF, "documents")
    model = quality.train(docs, table(spark, SF, "labels"))
    kept = [(r["doc_id"], r["text"]) for r in quality.classify(docs, model).filter("predicted = 1").collect()]
    groups = brute.jaccard_components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    leaked = {i for i, _ in brute.contained(kept, [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()])}
    kept = [(i, t) for i, t in kept if i not in leaked]
    clean = pii.redact(spark.createDataFrame(kept, "doc_id long, text string"))
    want = sorted(map(tuple, bpe.encode(clean, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=False).collect()))
    assert sorted(map(tuple, pipe.run(spark, SF).collect())) == want and 0 < len(want) < docs.count()


def test_stages_on_odd_rows(spark, docs, no_docs):
    for given in (docs, no_docs):
        for _, stage in pipe.STAGES[:-1]:
            out = stage(spark, given, SF)
            assert out.columns == given.columns and out.count() <= given.count()
        assert pipe.STAGES[-1][1](spark, given, SF).count() == given.count()
    clash = {r["score"] for r in pipe.keep_good(spark, docs, SF).collect()}
    assert clash <= {"clash"}
