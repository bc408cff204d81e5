import hashlib
import random

import public_tokenizers as P
import tiktoken

from matricula.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def _library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_documents_match_the_library(spark, sf):
    enc = _library()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.digests(docs, PATH).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_random_short_texts_match_the_library(spark):
    rnd = random.Random(0)
    alphabet = "''''slvretdmax  \n\t!é9 　ß日.\x85́"
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))) for i in range(8000)]
    enc = _library()
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, offsets=True).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        at, raw = 0, texts[r.doc_id].encode()
        for k, i in enumerate(ids):
            assert int.from_bytes(bytes(r.starts)[8 * k : 8 * k + 8], "little") == at
            at += len(enc.decode_single_token_bytes(i))
        assert at == len(raw)


def test_long_pieces_and_edge_rows(spark):
    enc = _library()
    texts = {1: None, 2: "", 3: "a" * 30000, 4: " " * 5000 + "x", 5: "<|endoftext|>", 6: "word " * 50000, 7: "'" * 999 + "ll"}
    rows = [(k, v, "c") for k, v in texts.items()] + [(None, "it's", "c"), (5, "<|endoftext|>", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(got) == 9
    for r in got:
        text = (texts[r.doc_id] if r.doc_id is not None else "it's") or ""
        assert bytes(r.decoded).decode() == text
        if len(text) < 30000:
            assert r.n_tokens == len(enc.encode_ordinary(text))
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_both_merges_agree():
    ranks = bpe.load_ranks(PATH)
    enc = _library()
    rnd = random.Random(1)
    for n in (5, 24, 25, 60):
        for _ in range(50):
            s = "".join(rnd.choice("abcdeinost") for _ in range(n))
            assert list(bpe.merge(s.encode(), ranks)) == enc.encode_ordinary(s)


def test_two_rank_files_in_one_session(spark, tmp_path):
    """Workers are reused: what they keep of one vocabulary is not used for another."""
    import base64

    single = tmp_path / "bytes.tiktoken"
    single.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))
    text = "the same words again, words"
    df = spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string")
    for path, want in ((PATH, len(_library().encode_ordinary(text))), (str(single), len(text)), (PATH, len(_library().encode_ordinary(text)))):
        got = bpe.decode(bpe.encode(df, path), path).collect()
        assert {(r.n_tokens, bytes(r.decoded)) for r in got} == {(want, text.encode())}
