"""Round trips of token records and archives, against brute force."""

import base64
import functools
import gzip
import hashlib
import io
import os
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listingspark.llm import binrecords as B
from listingspark.llm import warc as W
from listingspark.llm.common import Scratch
from listingspark.llm.queries import vocabulary_path

public_tokenizers = pytest.importorskip("public_tokenizers")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


PIECES = [*"aAbZ'sétΣς1 .,!\n\t\x0b\x1c\xa0\u0301<|>", "<|endoftext|>", "n't", "don't", "<|ENDOFTEXT|>", "  "]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=30).map("".join)


@given(st.lists(TEXTS, max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_encoder_equals_whole_texts(texts):
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u2").tolist() for x in B.WordEncoder(vocabulary_path(), False).encode(texts)]
    assert got == want


@functools.cache
def loaded():
    return tokenizer()


SIGNED = st.lists(st.sampled_from([*PIECES, *B.SIGNS, *"\x01xYé_", "\u0338", "'s", "'RE", "12", "ß", "漢"]), max_size=30).map("".join)


@given(st.lists(SIGNED | st.none(), max_size=6), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_signs_and_border_words_equal_whole_texts(texts, skip):
    texts = texts[skip:]
    want = [e.ids for e in loaded().encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for wide, kind in ((False, "<u2"), (True, "<u4")):
        got = B.WordEncoder(vocabulary_path(), wide).encode(pa.array(["x, y"] + texts, pa.string()).slice(1))
        assert [np.frombuffer(x, kind).tolist() for x in got] == want


class Counting:
    """A tokenizer that keeps the texts it was given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.inner.encode_batch_fast(texts, **more)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def test_new_words_share_a_call_and_signs_are_no_new_words(monkeypatch, tmp_path):
    import tokenizers

    (tmp_path / "t.json").write_bytes(open(vocabulary_path(), "rb").read())  # a path that no table has yet
    inner, counting = loaded(), Counting(loaded())
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Stub", (), {"from_file": staticmethod(lambda path: counting)}))
    encoder = B.WordEncoder(str(tmp_path / "t.json"), False)
    words = ["q" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(3200)]
    for end in ("", ".", ",", "!?", '"', "(x)"):
        text = " ".join(w + end for w in words)
        assert encoder.encode([text]) == [np.array(inner.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]
    assert len(counting.texts) <= 110


def test_a_full_word_table_starts_anew(monkeypatch):
    monkeypatch.setattr(B, "WORD_TABLE", 5)
    encoder = B.WordEncoder(vocabulary_path(), False)
    for text in ("some words, more words and others", " other words and others ", "some more"):
        assert np.frombuffer(encoder.encode([text, None])[0], "<u2").tolist() == loaded().encode(text, add_special_tokens=False).ids


def test_full_word_tables_keep_what_is_met_again_and_no_long_words(monkeypatch, tmp_path):
    import tokenizers

    (tmp_path / "t.json").write_bytes(open(vocabulary_path(), "rb").read())
    inner, counting = loaded(), Counting(loaded())
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Stub", (), {"from_file": staticmethod(lambda path: counting)}))
    monkeypatch.setattr(B, "WORD_TABLE", 500)
    encoder = B.WordEncoder(str(tmp_path / "t.json"), False)
    for k in range(20):
        text = " ".join(["met again", *(f"w{k}x{i}" for i in range(200)), f"{k}long" * 5000])
        assert encoder.encode([text]) == [np.array(inner.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]
    given_ = " ".join(counting.texts).split()
    assert given_.count("again") == 1 and given_.count("w3x7") == 1
    kept = [(w, ids) for table in B._tables[encoder.key][3] for w, ids in table.items()]
    assert len(kept) <= 1000 and sum(len(w) + len(ids) for w, ids in kept) < 50_000


def test_freed_memory_goes_back_behind_each_batch():
    code = """
import re
import pyarrow as pa
from listingspark.llm import binrecords as B, texthash as H
from listingspark.llm.queries import vocabulary_path

def held():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

encoder = B.WordEncoder(vocabulary_path(), False)
batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"some{i * j % 5000} words" for j in range(150)) for i in range(10_000)]})
for slice_ in H.chunks(batch, "text"):
    encoder.encode(slice_.column("text"))
before = held()
pa.default_memory_pool().release_unused()
print(before - held())
"""
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p), "ARROW_DEFAULT_MEMORY_POOL": "mimalloc"}
    got = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120, check=True)
    assert float(got.stdout) < 8


def test_vocabularies_that_join_signs_to_words_are_not_cut(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    whole = Tokenizer(models.WordLevel({"ab,": 0, ",": 1, "ab": 2, "[UNK]": 3}, unk_token="[UNK]"))
    whole.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    whole.save(path := str(tmp_path / "t.json"))
    text = "ab, ab unknown , ab,ab \x01 ab,"
    assert np.frombuffer(B.WordEncoder(path, False).encode([text])[0], "<u2").tolist() == whole.encode(text).ids == [0, 2, 3, 1, 3, 3, 0]


def expected(rows):
    t = tokenizer()
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_records_round_trip(spark):
    rows = [(i * 3 % 50, f"Text number {i} " * (i % 9)) for i in range(50)] + [(1000, None), (1001, ""), (None, "no id"), (1002, "long words " * 30000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start long")
    got = B.token_records(docs, vocabulary_path())
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows)
    assert B.token_records(docs.limit(0), vocabulary_path()).count() == 0


def test_repeated_rows_are_records_of_their_own(spark):
    docs = spark.createDataFrame([(5, "a b")] * 3 + [(5, "c")], "doc_id long, text string")
    got = B.token_records(docs, vocabulary_path()).collect()
    assert len(got) == 4 and sorted(r.start for r in got) == sorted(np.cumsum([0, *[r.n_tokens for r in sorted(got, key=lambda r: r.start)]])[:-1])


def test_ids_and_a_broken_checksum(spark):
    folder = Scratch(spark, "t").folder("s")
    docs = spark.createDataFrame([(1, "hello world"), (2, "again")], "doc_id long, text string")
    manifest = B.write_records(docs, folder, vocabulary_path(), shards=1)
    ids = {r.doc_id: list(r.ids) for r in B.read_records(manifest, folder).collect()}
    assert ids[1] == [*tokenizer().encode("hello world", add_special_tokens=False).ids, 1]
    shard = manifest.head()["shard"]
    path = f"{folder.removeprefix('file://')}/part-{shard:08d}.rec"
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        B.read_records(manifest, folder).collect()


def brute(rows, least):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for i, _, h in rows:
        top[digest(h)] = max(top.get(digest(h), i), i)
    out = []
    for i, _, h in rows:
        size, d = len((h or "").encode()), digest(h)
        again = size >= least and top[d] != i
        out.append((i, size, d, "revisit" if again else "response", top[d] if again else None))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 4])
def test_archives_round_trip(spark, monkeypatch, least):
    rows = [(i, f"http://x/{i}?a=%20é", ["<p>same</p>", "", None, f"<p>{i}</p>", "é" * 5000, "abc"][i % 6]) for i in range(30)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")
    got = W.archive_pages(pages, least)
    assert sorted(map(tuple, got.drop("url").collect())) == brute(rows, least)
    assert {r.page_id: r.url for r in got.collect()} == {i: u for i, u, _ in rows}
    assert W.archive_pages(pages.limit(0)).count() == 0


def test_null_page_fields(spark):
    pages = spark.createDataFrame([(None, None, "x"), (None, "u\r\nv", None)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.record_type) for r in W.archive_pages(pages).collect()), key=str)
    assert got == [(None, "u%0D%0Av", 0, "response"), (None, None, 1, "response")]


def test_chunks_and_archive_format(spark, monkeypatch):
    scratch = Scratch(spark, "w")
    page = spark.createDataFrame([(1, "http://a", "z" * (3 << 20))], "page_id long, url string, html string").selectExpr("page_id", "url", "encode(html, 'utf-8') as html")
    chunks = W.record_chunks(W.plan_records(page, scratch))
    rows = sorted(chunks.collect(), key=lambda r: r.chunk)
    assert [len(r.data) for r in rows] == [1 << 20] * 3
    assert rows[-1].running_digest == rows[-1].payload_digest != rows[0].running_digest
    archives = W.write_archives(chunks, scratch.folder("a"))
    name = archives.head()["archive"]
    raw = gzip.GzipFile(fileobj=io.BytesIO(open(f"{scratch.folder('a').removeprefix('file://')}/{name}", "rb").read())).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"z\r\n\r\n")
    back = sorted(W.read_archives(archives, scratch.folder("a")).collect(), key=lambda r: r.chunk)
    assert b"".join(r.data for r in back) == b"z" * (3 << 20)


def test_tokenizers_that_keep_white_space_are_refused(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(Exception, match="keeps white space"):
        B.token_records(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
