"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, the lowest first. Level k holds the k-th chunks of all ids that
have one, a bitmap that says which of them go on, and a directory with the rank of every 512th bit.
Token i is found by one rank a level, without decoding a block. A file also holds its documents' ids
and first tokens. Files are written in ascending document order, under temporary names, and a
manifest, written last into the same folder, gives each file's place among all tokens.

Edge cases: a null or empty text is the end id alone; documents with a null id come first, and rows that
repeat an id are documents of their own, in order of a hash of their text; an empty table gives no files. A very long text is
encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, arrow_rows, commit, give_back, held, lean, open_fs, parts, range_bounds, range_shards, roomy, save, scratch, text_slices, trim

MAGIC = b"TGDAC01\n"
BLOCK = 512
#: Tokens a file holds before the next begins.
FILE_TOKENS = 4 << 20
END_ID = 2
#: Texts that are sent to Python at a time.
ROWS = 2500


def pack(ids: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray, offsets: np.ndarray) -> bytes:
    """One file. offsets: of each document's first token, and the end."""
    sections: list[tuple[str, np.ndarray]] = [("docs", doc_ids.astype("<i8")), ("null", np.packbits(doc_null, bitorder="little")), ("offsets", offsets.astype("<i8"))]
    rest, level = ids.astype(np.uint32), 0
    while True:
        sections.append((f"chunks{level}", (rest & np.uint32(255)).astype(np.uint8)))
        more = rest > 255
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
        bits[: len(rest)] = more
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1))])
        sections += [(f"bits{level}", np.packbits(bits, bitorder="little")), (f"ranks{level}", ranks.astype("<u4"))]
        level += 1
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    index, at = {}, 0
    for name, a in sections:
        index[name] = [at, a.nbytes]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "levels": level, "sections": index}).encode()
    head += b" " * (-len(head) % 8)
    out = [MAGIC, struct.pack("<Q", len(head)), head]
    for _, a in sections:
        out += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
    return b"".join(out)


class TokenFile:
    """Random access to a packed file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<Q", data[8:16])
        self.head = json.loads(data[16 : 16 + n])
        at = 16 + n
        get = lambda name, kind: np.frombuffer(data, kind, self.head["sections"][name][1] // np.dtype(kind).itemsize, at + self.head["sections"][name][0])
        docs = self.head["docs"]
        self.docs, self.offsets = get("docs", "<i8"), get("offsets", "<i8")
        self.null = np.unpackbits(get("null", np.uint8), bitorder="little")[:docs].astype(bool)
        self.levels = [(get(f"chunks{k}", np.uint8), get(f"bits{k}", np.uint8), get(f"ranks{k}", "<u4")) for k in range(self.head["levels"])]

    def __len__(self) -> int:
        return self.head["tokens"]

    def get(self, where: np.ndarray) -> np.ndarray:
        """The ids at any places, in the order asked."""
        where = np.asarray(where, dtype=np.int64)
        out, live = np.zeros(len(where), np.uint32), np.arange(len(where))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[live] |= chunks[where].astype(np.uint32) << np.uint32(8 * k)
            on = ((bits[where >> 3] >> (where & 7).astype(np.uint8)) & 1).astype(bool)
            live, where = live[on], where[on]
            if not len(live):
                break
            where = self._rank(bits, ranks, where)
        return out

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's count, and those of the block's bytes before it."""
        block = where // BLOCK
        if len(where) and len(where) * 16 > len(bits):  # most of the file is asked for: one pass over the bytes
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            full = before[where >> 3]
        else:
            at = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
            full = ranks[block].astype(np.int64) + np.where(at < (where >> 3)[:, None], np.bitwise_count(bits[at]), 0).sum(axis=1, dtype=np.int64)
        return full + np.bitwise_count(bits[where >> 3] & ((1 << (where & 7)) - 1).astype(np.uint8)).astype(np.int64)


def ragged(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` values of a pool that begin at ``at``, one after the other."""
    ends = np.cumsum(n)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - n), n)]


class Pieces:
    """Pieces that were encoded, and their ids in one pool."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.ends = np.zeros(1 << 12, np.int64)  # piece k's ids are pool[ends[k] : ends[k + 1]]
        self.pool = np.zeros(1 << 14, np.uint32)

    def add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.at), len(pieces)
        used = int(self.ends[n])
        while n + m + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.ends[n + 1 : n + m + 1] = used + np.cumsum(counts)
        self.pool[used : used + len(ids)] = ids
        self.at.update(zip(pieces, range(n, n + m), strict=True))


class Encoder:
    """The tokenizer's ids of whole texts, with its results for space-led pieces kept.

    A single space between two characters that aren't white space always begins a pre-token of the
    byte-level BPE, so such pieces can be encoded by themselves: a run of texts is cut and its pieces told apart
    by Arrow, only those not seen before go to the tokenizer, and the ids are gathered. Texts with any other
    use of spaces next to white space, or that may hold a special token, go to the tokenizer whole, and so do all texts
    where the tokenizer isn't of this kind.
    """

    #: Texts that aren't cut: white space beside a space, rarer white space, what might be a special token.
    ODD = r"\x00|<\||[ \n\t\v\f\r\x1c-\x1f] | [\n\t\v\f\r\x1c-\x1f]|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    #: Pieces a generation keeps; the one before is still looked into, so what recurs stays.
    MOST = 500_000
    #: Bytes of text that are cut at a time, and new pieces that share a call.
    RUN, CALL = 8 << 20, 256

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            told = json.load(f)
        cut = told.get("pre_tokenizer") or {}
        self.cuts = told.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        # between the pieces of a call: whatever stands around it, the text is cut there
        self.mark, self.between = next(((k, t.content) for k, t in self.tok.get_added_tokens_decoder().items() if t.special and not t.normalized and "<|" in t.content), (None, None))
        self.new, self.old = Pieces(), Pieces()

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each) by the tokenizer alone."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.array([len(x) for x in got], np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces that the new generation lacks come into it: from the old one, or by the tokenizer."""
        if self.old.at:
            got = list(map(self.old.at.get, pieces))
            known = np.array([k for k in got if k is not None], np.int64)
            n = self.old.ends[known + 1] - self.old.ends[known]
            self.new.add([p for p, k in zip(pieces, got, strict=True) if k is not None], ragged(self.old.pool, self.old.ends[known], n), n)
            pieces = [p for p, k in zip(pieces, got, strict=True) if k is None]
        step = 1 if self.mark is None else self.CALL
        for a in range(0, len(pieces), 64 * step):
            some = pieces[a : a + 64 * step]
            if self.mark is None:
                ids, n = self.whole(some)
            else:
                ids, _ = self.whole([self.between.join(some[k : k + step]) + self.between for k in range(0, len(some), step)])
                marks = np.flatnonzero(ids == self.mark)
                n = np.diff(marks, prepend=-1) - 1
                ids = ids[ids != self.mark]
            self.new.add(some, ids, n)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each text) of texts that may be cut."""
        if len(self.new.at) > self.MOST:
            self.old, self.new = self.new, Pieces()
        words = pc.split_pattern(texts, " ")
        offs = words.offsets.to_numpy() - words.offsets[0].as_py()
        told, first = words.flatten().dictionary_encode(), words.flatten().take(pa.array(offs[:-1])).dictionary_encode()
        # a text's first piece has no space before it
        codes = told.indices.to_numpy().copy()
        codes[offs[:-1]] = first.indices.to_numpy() + len(told.dictionary)
        pieces = [*pc.binary_join_element_wise("", told.dictionary, " ").to_numpy(zero_copy_only=False).tolist(), *first.dictionary.to_pylist()]
        got = list(map(self.new.at.get, pieces))
        if None in got:
            self._learn([p for p, k in zip(pieces, got, strict=True) if k is None])
            got = list(map(self.new.at.__getitem__, pieces))
        got = np.array(got, np.int64)
        del words, told, first, pieces  # room for the ids
        at, n = self.new.ends[got], (self.new.ends[got + 1] - self.new.ends[got]).astype(np.int32)
        each = n[codes]
        upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        ids = np.empty(upto[-1], np.uint32)
        step = 1 << 17  # words at a time
        for a in range(0, len(codes), step):
            ids[upto[a] : upto[min(a + step, len(codes))]] = ragged(self.new.pool, at[codes[a : a + step]], each[a : a + step])
        return ids, np.diff(upto[offs])

    def encode(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of each text) of run after run of texts; null texts are empty."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        col = col.fill_null("")
        for a, b, _, _ in text_slices(col, self.RUN):
            some = col.slice(a, b - a)
            odd = pc.match_substring_regex(some, self.ODD) if self.cuts else pa.array([True] * len(some))
            bad = odd.to_numpy(zero_copy_only=False).astype(bool)
            if not bad.any():
                yield self._cut(some)
                continue
            x, nx = self.whole(some.filter(odd).to_pylist())
            y, ny = self._cut(some.filter(pc.invert(odd))) if not bad.all() else (x[:0], nx[:0])
            n = np.zeros(len(some), np.int64)
            n[bad], n[~bad] = nx, ny
            at = np.zeros(len(some), np.int64)
            at[bad], at[~bad] = np.cumsum(nx) - nx, len(x) + np.cumsum(ny) - ny
            yield ragged(np.concatenate([x, y]), at, n), n


def encoder(path: str) -> Encoder:
    """One a Python worker, so that its tasks share what they have learnt."""
    return held(("encoder", path), lambda: Encoder(path))


def write(df: DataFrame, root: str, tokenizer: str, ident: str = "doc_id", text: str = "text", end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the files and their manifest below ``root``; the manifest has file, part, seq, docs, tokens, crc32, first_token."""
    rows = df.select(F.col(ident).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    bounds = range_bounds(rows.withColumn("size", F.length("t") + 16), "id", "h", "size")
    rows = range_shards(rows, "id", "h", bounds).sortWithinPartitions("_at", "h", "id", "t").select("id", "t", "shard")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        enc, files = encoder(tokenizer), None
        docs: list[tuple[np.ndarray, np.ndarray]] = []  # ids, and which of them are null
        made: list[tuple[np.ndarray, np.ndarray]] = []  # tokens, and their number by document
        size = 0
        said: list[tuple] = []

        def flush() -> None:
            nonlocal docs, made, size
            ids, counts = (np.concatenate([x[k] for x in made]) for k in (0, 1))
            own, null = (np.concatenate([x[k] for x in docs]) for k in (0, 1))
            made.clear()
            data = pack(ids, own, null, np.concatenate([[0], np.cumsum(counts)]))
            files.start().write(data)
            seq = files.seq
            said.append((files.close(), files.part, seq, len(own), len(ids), zlib.crc32(data)))
            docs, made, size = [], [], 0

        for b in batches:
            if not b.num_rows:
                continue
            files = files or Rolling(root, b.column("shard")[0].as_py(), ".dac")  # a partition is a shard
            own = b.column("id")
            null, own = own.is_null().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            for ids, counts in enc.encode(b.column("t")):
                trim()
                ids, counts = np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
                a = done = 0
                upto = np.cumsum(counts)
                while a < len(counts):  # a file ends with the document that fills it
                    z = min(len(counts), int(np.searchsorted(upto, done + file_tokens - size)) + 1)
                    made.append((ids[done : upto[z - 1]], counts[a:z]))
                    docs.append((own[at + a : at + z], null[at + a : at + z]))
                    size += int(upto[z - 1]) - done
                    a, done = z, int(upto[z - 1])
                    if size >= file_tokens:
                        flush()
                at += len(counts)
        if docs:
            flush()
        trim()
        names = ("file", "part", "seq", "docs", "tokens", "crc32")
        yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in said], pa.string() if not k else pa.int64()) for k, c in enumerate(names)})

    give_back(df.sparkSession)
    with arrow_rows(df.sparkSession, ROWS):
        said = save(rows.mapInArrow(encode, "file string, part long, seq long, docs long, tokens long, crc32 long", profile=roomy(df.sparkSession)), "token-manifest")
    parted = said.groupBy("part").agg(F.sum("tokens").alias("_all"))
    before = parted.select(F.col("part"), F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))  # a row a shard
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_ahead") + F.coalesce(F.sum("tokens").over(order), F.lit(0))
    return commit(said.join(before, "part").withColumn("first_token", first).select(*said.columns, "first_token"), root)


def read(manifest: DataFrame, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        for b in batches:
            for name, first, crc in zip(*(b.column(c).to_pylist() for c in ("file", "first_token", "crc32")), strict=True):
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                if zlib.crc32(data) != crc:
                    raise OSError(f"{name} is not the file that the manifest names")
                t = TokenFile(data)
                step = max(1, len(t.docs) // 8)
                for a in range(0, len(t.docs), step):
                    o = t.offsets[a : a + step + 1]
                    ids = t.get(np.arange(o[0], o[-1])).astype("<u4")
                    crcs = [zlib.crc32(ids[x - o[0] : y - o[0]].tobytes()) for x, y in zip(o[:-1], o[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(t.docs[a : a + step], pa.int64(), mask=t.null[a : a + step]), "start": pa.array(o[:-1] + first, pa.int64()), "n_tokens": pa.array(np.diff(o), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    spark = manifest.sparkSession
    n = max(1, min(4 * parts(spark), manifest.count()))
    return manifest.select("file", "first_token", "crc32").repartition(n).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def store(df: DataFrame, tokenizer: str | None = None, **kw) -> DataFrame:
    root = scratch(df.sparkSession, "tokens")
    return read(write(df, root, tokenizer or tokenizer_path(), **kw), root)


def query(spark, sf_dir: str) -> DataFrame:
    return store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
