"""Token-ID output: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

``write`` range-partitions documents by id, sorts each partition and writes three files for it in the
shared folder:

* ``.bin``: the ids of its documents one after the other, little-endian uint16 if the vocabulary has at
  most 65,536 ids, else uint32; every document ends with the end id;
* ``.off``: little-endian uint64, one more than documents: where each document starts in ``.bin``, in ids;
* ``.ids``: little-endian int64 document ids; 0 stands for null. Null ids come last, and the manifest counts them.

The manifest has one row per partition with its counts; prefix sums over it give each partition's base,
so the global start of a document is base + offset. Files of a task that ran again have other names, and
only the manifest's are read. ``read_back`` maps the files into memory where they are local, else reads
them by ranges.

Words between ASCII blanks are encoded once and kept in a bounded cache, which lasts for a worker's later tasks:
the tokenizer drops white space and no token crosses it, so the ids of a text are those of its words in order.

Defined cases: null text is empty and has the end id alone; null ids come last; rows with equal ids follow
each other in order of their texts' hashes; an empty table gives no partitions with documents.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import fs_of, read, released, shared_dir, table, text_chunks

END_ID = 2
#: Words of a generation of the cache; there are two. About 130 bytes each.
CACHE_WORDS = 500_000
#: Ids that are read at once (or one document) where files can't be mapped into memory.
RANGE_IDS = 1 << 21
MANIFEST = "part int, file string, n_docs long, n_null long, n_tokens long, width int"
INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """ids, as bytes, of texts: word by word through a cache if the tokenizer drops white space, else whole.

    The cache has two generations, so that frequent words stay when it is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.width = self.kind.itemsize
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        setup = json.loads(self.tokenizer.to_str())
        self.by_word = _drops_blanks(setup)
        suffix = setup["model"].get("end_of_word_suffix")
        self.code = "H" if self.width == 2 else "I"
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if suffix:
            self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[array]:
        return [array(self.code, e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids: array) -> bytes:
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Words of ASCII letters are single pieces, each of which ends in one id with the end-of-word suffix: they share calls."""
        shared = bool(self.last.any())
        plain = [w for w in new if w.isalpha()] if shared else []
        rest = [w for w in new if not w.isalpha()] if shared else new
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for group, ids in zip(groups, self._ids([b" ".join(g).decode() for g in groups]), strict=True):
            ends = np.flatnonzero(self.last[np.frombuffer(ids, ids.typecode)]) + 1
            if len(ends) != len(group):
                rest += group
                continue
            data, lo = self._bytes(ids), 0
            for w, hi in zip(group, (ends * self.width).tolist(), strict=True):
                self.young[w] = data[lo:hi]
                lo = hi
        for w, ids in zip(rest, self._ids([w.decode("utf-8", "replace") for w in rest]), strict=True):
            self.young[w] = self._bytes(ids)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [self._bytes(x) for x in self._ids([t.decode("utf-8", "replace") for t in texts])]
        parts = [t.split() for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        new = []
        for w in set().union(*parts) - self.young.keys():
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                new.append(w)
        self._learn(new)
        return [b"".join(map(self.young.__getitem__, p)) for p in parts]


def _drops_blanks(setup: dict) -> bool:
    """Whether the text is cut at white space, which is then removed, so that no id depends on both sides of a blank."""
    pre = setup.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    rest = r"[^\s\p{L}\p{N}]+"
    cuts = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and rest in pattern and r"\s" not in pattern.replace(rest, "")
    return bool(cuts) and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in setup.get("added_tokens", []))


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files of docs (doc_id, text); return the manifest, a table under folder."""
    spark = docs.sparkSession
    path = path or vocabulary()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_last(), tie.asc()]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, *order).sortWithinPartitions(*order)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        tail = np.array([end_id], f"<u{encode.width}").tobytes()
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        fs, base = fs_of(name)
        n_docs = n_null = n_tokens = 0
        files = {}
        try:
            for k in ("bin", "off", "ids"):
                files[k] = fs.open_output_stream(f"{base}.{k}", compression=None, buffer_size=1 << 20)
            files["off"].write(np.zeros(1, "<u8").tobytes())
            for part, data, off in text_chunks(batches):
                done = [x + tail for x in encode([data[off[i] : off[i + 1]].tobytes() for i in range(part.num_rows)])]
                ends = n_tokens + np.cumsum([len(x) // encode.width for x in done])
                files["bin"].write(b"".join(done))
                files["off"].write(ends.astype("<u8").tobytes())
                n_tokens = int(ends[-1])
                ids = part.column("doc_id")
                files["ids"].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_null = n_docs + part.num_rows, n_null + ids.null_count
        finally:
            for f in files.values():
                f.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "n_docs": [n_docs], "n_null": [n_null], "n_tokens": [n_tokens], "width": pa.array([encode.width], pa.int32())})

    return table(spark, dealt.mapInArrow(released(put), MANIFEST), f"{folder}/manifest")


def _open(uri: str, kind: str) -> np.ndarray:
    """A whole file of numbers: mapped into memory where it is local, else read."""
    fs, path = fs_of(uri)
    if not fs.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _ranges(uri: str, kind: str, off: np.ndarray, most: int = RANGE_IDS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, stop, ids) of runs of documents: one mapped run of a local file, else runs of at most ``most`` ids or one document."""
    fs, path = fs_of(uri)
    n = len(off) - 1
    if isinstance(fs, pafs.LocalFileSystem):
        yield 0, n, _open(uri, kind)
        return
    width = np.dtype(kind).itemsize
    with fs.open_input_file(path) as f:
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield lo, hi, np.frombuffer(f.read_at((int(off[hi]) - int(off[lo])) * width, int(off[lo]) * width), kind)
            lo = hi


def documents(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the partition, ids) of each document of a manifest row."""
    ids, off = _open(row["file"] + ".ids", "<i8"), _open(row["file"] + ".off", "<u8").astype(np.int64)
    null = len(ids) - row["n_null"]
    for lo, hi, flat in _ranges(row["file"] + ".bin", f"<u{row['width']}", off):
        for i in range(lo, hi):
            yield int(ids[i]) if i < null else None, int(off[i]), flat[off[i] - off[lo] : off[i + 1] - off[lo]]


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids as uint32, of every document in the files."""
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r["part"])  # a row for each partition
    base, based = 0, []
    for r in rows:
        if r["n_docs"]:
            based.append((r["file"], r["width"], r["n_null"], base))
        base += r["n_tokens"]
    parts = spark.createDataFrame(based, "file string, width int, n_null long, base long")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for row in b.to_pylist():
                out = []
                for doc, at, ids in documents(row):
                    out.append((doc, row["base"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    return parts.repartition(max(1, len(based))).mapInArrow(released(get), INDEX)


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs as token files and return what the files hold."""
    return read_back(write(docs, shared_dir(docs.sparkSession, "tokens"), path, end_id))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(read(spark, sf_dir, "documents"))


QUERIES = {"op4_token_ids": op4_token_ids}
ORACLE: dict[str, str] = {}
