"""Token ids as length-delimited binary records with masked checksums and offset indexes.

A shard is two files. ``part-N.rec`` holds one record for each document:

    payload length  u64 | masked crc32 of those 8 bytes  u32 | payload | masked crc32 of it  u32

The payload is ``has_id u8 | doc_id i64 | ids u16[]`` (u32[] for vocabularies over
65,536), all little-endian. A checksum c is masked as ((c >> 15 | c << 17) + 0xa282ead8)
mod 2^32, so that checksums of data that hold checksums stay sound.
``part-N.idx`` holds, for each record, its byte offset and the number of ids before it in
the shard, both u64, and one closing pair: record k can be read alone, and shuffled reads
need no scan.

Shards are written in ascending document order over range partitions, one task each; the
list of shards, one small row each, goes through the driver as a commit list does.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.llm import texthash as H
from listingspark.llm.common import Scratch
from listingspark.llm.files import open_input, whole_file

MASK = 0xA282EAD8
#: Words of a generation whose ids a Python worker keeps, two generations at a time, and bytes of a word that is kept.
WORD_TABLE, KEPT_WORD = 200_000, 64
#: New words that the tokenizer gets as one text, and the word that stands between them.
GROUP, BORDER = 32, "\x01"
#: Words are cut where an ASCII letter meets one of these signs.
SIGNS = '.,;:!?*#$%&()"-/'
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = 1
_KINDS[[*SIGNS.encode()]] = 2
#: Records that a reading task takes from a shard at once.
BLOCK = 2048

MANIFEST = "shard long, records long, tokens long, bytes long"
_tables: dict[tuple[str, bool], tuple[object, list[int], bool, list[dict[bytes, bytes]]]] = {}


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def apart(column: pa.Array) -> pa.Array:
    """The texts with a space wherever an ASCII letter meets one of SIGNS, on either side; null texts are empty."""
    data, at = H.buffers(column)
    begin = int(at[0])
    data, at = data[begin : int(at[-1])], at - begin
    kinds = _KINDS[data]
    cuts = np.flatnonzero(kinds[:-1] + kinds[1:] == 3) + 1
    data = np.insert(data, cuts, 32)
    at = at + np.searchsorted(cuts, at)
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))


class WordEncoder:
    """Ids of whole texts by way of the ids of their distinct words.

    Exact for tokenizers whose pieces never hold white space, as the word-end
    vocabulary's: its split pattern takes white space for nothing but a border, and its
    normaliser maps white space to white space only. Each worker keeps the ids of words for
    later texts of all its tasks, in two generations: a full one becomes the older, and words
    met again move up, so that only words not met for long are encoded anew. Long words are
    not kept, so both have a bound in bytes. New words go to the tokenizer in
    groups, a border word between them; where the border's id turns up oftener than that,
    a word of the group has it too, and the group's words are encoded one by one.

    Where letters and SIGNS are in pieces of their own (the split pattern never crosses from
    one to the other, and no added token holds a sign), words are cut between them: far fewer
    are distinct.
    """

    def __init__(self, path: str, wide: bool):
        self.key, self.kind = (path, wide), np.dtype("<u4" if wide else "<u2")
        if self.key not in _tables:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            # words apart must give what the words give one by one, or the shortcut below is wrong
            probe = ["Words", "apart,", "12", "--", "é漢", BORDER, "x\u00a0y", "word"]
            ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
            if any(ids(gap.join(["", *probe, ""])) != [i for w in probe for i in ids(w)] for gap in (" ", "\n", " \t\r\n ")):
                raise ValueError(f"{path} keeps white space in its pieces: words cannot be encoded one by one")
            added = "".join(t.content for t in tokenizer.get_added_tokens_decoder().values())
            cut = not set(added) & set(SIGNS) and all(ids(f"ab{s}Word") == [i for w in ("ab", s, "Word") for i in ids(w)] for c in SIGNS for s in (c, c + c))
            _tables[self.key] = (tokenizer, ids(BORDER), cut, [{}, {}])

    def _learned(self, new: list[bytes]) -> dict[bytes, bytes]:
        tokenizer, border, _, _ = _tables[self.key]
        known = {b"": b""}  # before and after white space at a text's ends
        unit = self.kind.itemsize
        n = GROUP if len(border) == 1 else 1
        between = f" {BORDER} ".encode()
        for k in range(0, len(new), 4096):
            groups = [new[i : i + n] for i in range(k, min(k + 4096, len(new)), n)]
            for group, e in zip(groups, tokenizer.encode_batch_fast([between.join(g).decode() for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=self.kind)
                ends = np.flatnonzero(ids == border[0]).tolist() if len(group) > 1 else []
                if len(ends) == len(group) - 1:
                    data, lo = ids.tobytes(), 0
                    for w, hi in zip(group, [*ends, len(ids)], strict=True):
                        known[w] = data[unit * lo : unit * hi]
                        lo = hi + 1
                else:
                    for w, one in zip(group, tokenizer.encode_batch_fast([w.decode() for w in group], add_special_tokens=False), strict=True):
                        known[w] = np.array(one.ids, dtype=self.kind).tobytes()
        return known

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        generations = _tables[self.key][3]
        young, old = generations
        found = [young.get(w) or old.get(w) for w in words]
        new = self._learned([w for w, ids in zip(words, found, strict=True) if ids is None and w])
        found = [new[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        for w, ids in zip(words, found, strict=True):
            if len(w) <= KEPT_WORD:
                young[w] = ids
                if len(young) >= WORD_TABLE:
                    young, old = {}, young
        generations[:] = young, old
        return found

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        cut = _tables[self.key][2]
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        parts = pc.ascii_split_whitespace(apart(column) if cut else pc.fill_null(column, ""))
        words = parts.flatten().cast(pa.large_binary()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._ids(distinct)
        ids, unit = np.frombuffer(b"".join(found), self.kind), self.kind.itemsize
        size = np.fromiter(map(len, found), np.int64, len(found)) // unit
        start, code = np.cumsum(size) - size, words.indices.to_numpy()
        at = np.zeros(len(code) + 1, np.int64)
        np.cumsum(size[code], out=at[1:])
        data = ids[np.repeat(start[code] - at[:-1], size[code]) + np.arange(at[-1])].tobytes()
        cuts = (at[parts.offsets.to_numpy()] * unit).tolist()
        return [data[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _writer(folder: str, tokenizer: str, end_id: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = WordEncoder(tokenizer, wide)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        unit = encoder.kind.itemsize
        at = ids = records = 0
        with whole_file(f"{folder}/part-{shard:08d}.rec") as rec, whole_file(f"{folder}/part-{shard:08d}.idx") as idx:
            for whole in batches:
                for batch in H.chunks(whole, "text", 4 << 20):
                    index, out = [], []
                    for doc, body in zip(batch.column("id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                        head = struct.pack("<Bq", doc is not None, doc or 0)
                        payload = b"".join((head, body, end))
                        size = struct.pack("<Q", len(payload))
                        out += [size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))]
                        index.append(struct.pack("<QQ", at, ids))
                        at += len(payload) + 16
                        ids += len(body) // unit + 1
                        records += 1
                    rec.write(b"".join(out))
                    idx.write(b"".join(index))
            idx.write(struct.pack("<QQ", at, ids))
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "records": records, "tokens": ids, "bytes": at}] if records else [],
            schema=pa.schema([(n, pa.int64()) for n in ("shard", "records", "tokens", "bytes")]),
        )

    return run


def write_records(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    wide: bool = False,
) -> DataFrame:
    """Encodes and writes every row; returns the manifest (shard, records, tokens, bytes, before).

    ``before`` is the number of ids in all earlier shards. Documents are in ascending id
    order across and within shards; null ids come first, and rows that share an id are
    ordered by the hash of their text, which also lets ranges divide one hot id.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    order = ["id", F.xxhash64("text")]
    parts = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    with Scratch(spark, "records").small_batches():
        done = sorted(parts.mapInArrow(_writer(folder, tokenizer, end_id, wide), MANIFEST).collect())
    before, listed = 0, []
    for shard, records, tokens, size in done:
        listed.append((shard, records, tokens, size, before))
        before += tokens
    return spark.createDataFrame(listed, MANIFEST + ", before long")


def _reader(folder: str, wide: bool, digest: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def check(data: bytes, crc: bytes, what: str) -> None:
        if struct.unpack("<I", crc)[0] != masked(zlib.crc32(data)):
            raise ValueError(f"checksum of {what} does not match")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/part-{row['shard']:08d}"
                lo, hi = row["lo"], row["hi"]
                with open_input(name + ".idx") as idx:
                    idx.seek(16 * lo)
                    index = np.frombuffer(idx.read(16 * (hi - lo + 1)), "<u8").reshape(-1, 2)
                out: dict[str, list] = {"id": [], "start": [], "n_tokens": [], "ids": []}
                held = 0
                with open_input(name + ".rec") as rec:
                    rec.seek(int(index[0, 0]))
                    for k in range(hi - lo):
                        head = rec.read(12)
                        check(head[:8], head[8:], "a length")
                        size = struct.unpack("<Q", head[:8])[0]
                        payload = rec.read(size)
                        check(payload, rec.read(4), "a payload")
                        has, doc = struct.unpack("<Bq", payload[:9])
                        ids = np.frombuffer(payload, kind, offset=9)
                        if len(ids) != int(index[k + 1, 1] - index[k, 1]):
                            raise ValueError("the offset index does not match its records")
                        out["id"].append(doc if has else None)
                        out["start"].append(row["before"] + int(index[k, 1]))
                        out["n_tokens"].append(len(ids))
                        out["ids"].append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32))
                        held += size
                        if held > 4 << 20:
                            yield _batch(out, digest)
                            held, out = 0, {c: [] for c in out}
                yield _batch(out, digest)

    return run


def _batch(out: dict[str, list], digest: bool) -> pa.RecordBatch:
    last = pa.array(out["ids"], pa.int64() if digest else pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(out["id"], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["n_tokens"], pa.int64()), last],
        ["id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
    )


def read_records(manifest: DataFrame, folder: str, id_col: str = "doc_id", wide: bool = False, digest: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids) of every record, or ids_crc32 in place of ids.

    Shards are read in blocks of records by their offset index, each checksum is checked,
    and a block is a task's unit of work wherever it runs.
    """
    blocks = manifest.select(
        "shard",
        "before",
        "records",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(BLOCK).cast("long"))).alias("lo"),
    ).withColumn("hi", F.least(F.col("lo") + BLOCK, "records"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = "ids_crc32 long" if digest else "ids array<int>"
    out = blocks.repartition(n).mapInArrow(_reader(folder, wide, digest), f"id long, start long, n_tokens long, {last}")
    return out.withColumnRenamed("id", id_col)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as records into the shared folder and returns what the files hold.

    (id_col, start, n_tokens, ids_crc32): the ids of all documents before it, its ids
    with the end id, and the crc32 of them as little-endian unsigned 32-bit integers.

    Defined results: null and empty texts are the end id alone; null ids come first;
    repeated rows are records of their own; further columns are not read; an empty table
    gives an empty result.
    """
    folder = Scratch(docs.sparkSession, "records").folder("shards")
    manifest = write_records(docs, folder, tokenizer, end_id, id_col, text_col)
    return read_records(manifest, folder, id_col, digest=True)
