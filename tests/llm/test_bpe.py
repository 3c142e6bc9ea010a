import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventide.llm import bpe

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_librarys(docs, texts, twice, no_docs):
    library = Tokenizer.from_file(JSON)
    got = {r["doc_id"]: r for r in bpe.count_tokens(docs, JSON).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)
    assert bpe.count_tokens(twice, JSON).count() == 7 and bpe.count_tokens(no_docs, JSON).count() == 0


def test_ids_are_the_librarys(docs, texts, twice, no_docs):
    library = _tiktoken()
    got = {r["doc_id"]: r for r in bpe.encode(docs, RANKS).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        said = " ".join(map(str, ids))
        assert (got[i]["n_tokens"], got[i]["ids"]) == (len(ids), said)
        assert bytes(got[i]["decoded"]) == (t or "").encode()
        assert got[i]["ids_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(twice, RANKS).count() == 7 and bpe.encode(no_docs, RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_any_text(texts):
    counter, encoder = bpe.loaded(bpe.MergeCounter, JSON), bpe.loaded(bpe.RankEncoder, RANKS)
    library, other = Tokenizer.from_file(JSON), _tiktoken()
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [ids for ids, _ in encoder.encode(texts)] == [" ".join(map(str, other.encode_ordinary(t))) for t in texts]
    assert [back for _, back in encoder.encode(texts)] == [t.encode() for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = ["a few words of text", "other words entirely here", "a few words of text again"]
    assert bpe.MergeCounter(JSON).count(texts) == bpe.loaded(bpe.MergeCounter, JSON).count(texts)
    few = bpe.RankEncoder(RANKS)
    assert [few.encode([t])[0] for t in texts] == bpe.loaded(bpe.RankEncoder, RANKS).encode(texts)
