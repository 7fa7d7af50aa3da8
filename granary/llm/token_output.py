"""Operator 1: token ids in files of independent zstandard frames, one frame a document."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from contextlib import AbstractContextManager, ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Kept, give_back, small_batches, table, work_dir
from granary.llm.seekable import Reader, Writer, open_fs

#: Remembered words of a worker, in two generations: a full young one becomes the old one, whose words come back when used.
MEMO_WORDS = 800_000
#: Bytes that the remembered words and ids have, and the longest word that is remembered, in characters.
MEMO_BYTES, WORD_MOST = 96 << 20, 64
#: Rows and bytes of a batch: in a larger one fewer words are met again; and texts whose ids are gathered at once.
ENCODED_ROWS, ENCODED_BYTES, GATHERED = 4096, 10 << 20, 128
#: Unknown words that go to the library together.
JOINED_WORDS = 4000
#: Punctuation that, after letters, is a piece of its own. The apostrophe isn't among it: it may begin a contraction.
TAIL = ".,;:!?*#$%&|()[]{}\"-_/+=<>@^`~\\"
MANIFEST = "manifest.json"


def byte_alphabet() -> dict[int, str]:
    """The characters that a byte-level vocabulary writes for bytes: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}


ALPHABET = byte_alphabet()
SPACE, LINE = ALPHABET[32], ALPHABET[10]


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library, remembering those of words.

    The pre-tokenizer always begins a new piece at a single space between two non-space characters, so a text may be
    cut there: the ids of its words, each with the space before it, are the text's ids. Texts with other white space
    beside a space, or a space at an end, go to the library whole. A word of letters alone is one piece, which the
    library's model takes without pre-tokenizing; punctuation after letters is a second, a line's end a third.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would only wait
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.tokenizer.model)  # no pre-tokenizer
        self.end = np.array([end_id], "<u4").tobytes()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}  # letters that follow a line's end, with it
        self.held = 0  # bytes in memo
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character a byte
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parted(self, ids: np.ndarray, sizes: list[int]) -> list[bytes]:
        """ids of texts that follow each other, by the texts' sizes in bytes."""
        cuts = (4 * np.searchsorted(self.n_bytes[ids].cumsum(), np.cumsum(sizes)) + 4).tolist()
        held = ids.tobytes()
        return [held[a:b] for a, b in zip([0, *cuts], cuts)]

    def of_pieces(self, start: str, between: list[str], words: list[str]) -> list[bytes]:
        """ids of words of letters alone, each after the pieces in between and with `start` before its first letter."""
        out: list[bytes] = []
        more = sum(map(len, between))
        for at in range(0, len(words), JOINED_WORDS):
            own = [start + w if w.isascii() else start + w.encode().decode("latin-1").translate(ALPHABET) for w in words[at : at + JOINED_WORDS]]
            pieces = own if not between else [p for w in own for p in (*between, w)]
            ids = self.pieces.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids
            out += self.parted(np.array(ids, "<u4"), [len(w) + more for w in own])
        return out

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of unknown words, all different, each with a space before it; they are remembered."""
        out: list = list(map(self.old.get, words))
        rest = [k for k, x in enumerate(out) if x is None]
        letters = [k for k in rest if words[k].isalpha()]
        joined, others, cores, tails, lines = [], [], {}, set(), set()
        for k in rest:
            w = words[k]
            if w.isalpha():
                continue
            core = w.rstrip(TAIL)
            last = tail = ""
            if not core.isalpha():
                head, line, last = w.partition("\n")
                core = head.rstrip(TAIL)
                if not line or not last.isalpha() or not core.isalpha():
                    others.append(k)
                    continue
                lines.add(last)
                tail = head[len(core) :]
            else:
                tail = w[len(core) :]
            tails.add(tail)
            ids = self.memo.get(core) or self.old.get(core)
            cores[core] = ids
            joined.append((k, core, tail, last))
        fresh = [words[k] for k in letters]
        for k, ids in zip(letters, self.of_pieces(SPACE, [], fresh)):
            out[k] = ids
            if words[k] in cores:
                cores[words[k]] = ids
        missing = [c for c, ids in cores.items() if ids is None]
        cores.update(zip(missing, self.of_pieces(SPACE, [], missing)))
        for held in (self.tails, self.lines):
            if len(held) > MEMO_WORDS // 4 or sum(map(len, held)) > MEMO_BYTES // 8:
                held.clear()
        if new := list(tails - self.tails.keys()):
            self.tails.update(zip(new, self.ids(new)))
        if new := list(lines - self.lines.keys()):
            self.lines.update(zip(new, self.of_pieces("", [LINE], new)))
        for k, core, tail, last in joined:
            out[k] = cores[core] + self.tails[tail] + (self.lines[last] if last else b"")
        for at in range(0, len(others), JOINED_WORDS):
            some = [words[k] for k in others[at : at + JOINED_WORDS]]
            ids = np.frombuffer(self.ids([" " + " ".join(some)])[0], "<u4")
            for k, x in zip(others[at:], self.parted(ids, [len(w.encode()) + 1 for w in some])):
                out[k] = x
        for some in (cores.items(), zip(words, out)):
            kept = {w: ids for w, ids in some if len(w) <= WORD_MOST}
            self.memo.update(kept)
            self.held += sum(map(len, kept)) + sum(map(len, kept.values()))
        for held in (self.tails, self.lines):
            for w in [w for w in held if len(w) > WORD_MOST]:
                del held[w]
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_WORDS // 2 or self.held > MEMO_BYTES // 2:
            self.old, self.memo, self.held = self.memo, {}, 0
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        bounds = (bounds - bounds[0]).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        place, words = coded.indices.to_numpy().astype(np.int32), coded.dictionary.to_pylist()
        del split, coded
        give_back()  # the words' table is several times the text
        held = list(map(self.memo.get, words))
        new = [k for k, x in enumerate(held) if x is None]  # what is remembered is safe
        bad = [k for k in new if not words[k] or words[k][0].isspace() or words[k][-1].isspace()]
        whole = []
        if bad:
            unsafe = np.zeros(len(words), bool)
            unsafe[bad] = True
            whole = np.flatnonzero(np.add.reduceat(unsafe[place], bounds[:-1])).tolist()
            new = [k for k in new if not unsafe[k]]
            for k in bad:
                held[k] = b""
        for k, ids in zip(new, self.learn([words[k] for k in new])):
            held[k] = ids
        # a first word has no space before it; an end id follows each last word
        first = self.ids([words[k] for k in place[bounds[:-1]].tolist()])
        held += [*first, self.end]
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        begin = np.cumsum(size) - size
        place[bounds[:-1]] = len(words) + np.arange(len(texts))
        place = np.insert(place, bounds[1:], len(held) - 1)
        bounds = bounds + np.arange(len(bounds))
        joined = np.frombuffer(b"".join(held), "<u4")
        out: list[bytes] = []
        for k in range(0, len(texts), GATHERED):  # a part of the texts at a time, which bounds the scratch memory
            edges = bounds[k : k + GATHERED + 1]
            own = place[edges[0] : edges[-1]]
            length = size[own]
            stop = np.cumsum(length)
            flat = joined[np.repeat(begin[own] - (stop - length), length) + np.arange(int(stop[-1]))].tobytes()
            cut = [0, *(4 * stop[edges[1:] - edges[0] - 1]).tolist()]
            out += [flat[x:y] for x, y in zip(cut, cut[1:])]
        for k, ids in zip(whole, self.ids([texts[k].as_py() for k in whole])):
            out[k] = ids + self.end
        return out


_encoders = Kept(Encoder)


def encoder(path: str, end_id: int) -> AbstractContextManager[Encoder]:
    """A worker's encoder, kept with what it remembers while tasks follow each other."""
    return _encoders.use(path, end_id)


def shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.ids.zst"


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 0, level: int = 1) -> list[dict]:
    """Encode docs (doc_id, text) and write shards in ascending doc_id order; the manifest, one entry a shard.

    Null and empty texts are documents of the end id alone. Rows of one doc_id follow each other in the order of their
    texts' hashes; repeated rows are written once each. Null doc_ids come first and are stored as the lowest long.
    No rows: no shards. Other columns are ignored. A shard's index holds its doc_ids; frame k is document k.
    """
    small_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ENCODED_ROWS))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ENCODED_BYTES))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, writer, ids, total = TaskContext.get().partitionId(), None, None, [], 0
        with ExitStack() as uses:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    encode, writer = uses.enter_context(encoder(tokenizer_path, end_id)), Writer(shard_uri(folder, shard), level)
                ids.append(batch.column(0).to_numpy().copy())  # a view would hold the texts, which share its buffer
                for content in encode(batch.column(1)):
                    total += len(content) // 4
                    writer.frame(content)
                give_back()
        if writer is not None:
            held = np.concatenate(ids)
            writer.close(held.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(held), total, held[0], held[-1])], ["shard", "n_docs", "n_tokens", "first", "last"])

    found = ranged.mapInArrow(run, "shard long, n_docs long, n_tokens long, first long, last long").collect()  # a row a shard
    start, manifest = 0, []
    for r in sorted(found, key=lambda r: r.shard):
        manifest.append({**r.asDict(), "start": start})
        start += r.n_tokens
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> list[dict]:
    """The shards of a folder, as write_ids left them there: number, documents, ids, first and last doc_id, start."""
    fs, path = open_fs(folder)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_document(folder: str, manifest: list[dict], doc_id: int) -> np.ndarray | None:
    """The ids of one document, from the frames of its own alone; None if it isn't there. Only shards whose range holds
    the doc_id are opened."""
    for entry in manifest:
        if not entry["first"] <= doc_id <= entry["last"]:
            continue
        reader = Reader(shard_uri(folder, entry["shard"]))
        try:
            held = np.frombuffer(reader.index, "<i8")
            k = int(np.searchsorted(held, doc_id))
            if k < len(held) and held[k] == doc_id:
                return np.frombuffer(reader.frame(k), "<u4")
        finally:
            reader.close()
    return None


def read_ids(spark: SparkSession, folder: str, manifest: list[dict] | None = None) -> DataFrame:
    """What the shards hold, a row a document: doc_id, start, n_tokens, ids_crc32. All of it comes from the files: where
    a shard starts, too, from the sizes in the seek tables of those before it."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    shards = [e["shard"] for e in (read_manifest(folder) if manifest is None else manifest)]
    listed = lambda tasks, columns: spark.createDataFrame(spark.sparkContext.parallelize(tasks, max(1, min(len(tasks), 10_000))), columns)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                reader = Reader(shard_uri(folder, shard))
                total = int(reader.entries["size"].sum(dtype=np.int64)) // 4
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([total], pa.int64())], ["shard", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                reader, start = Reader(shard_uri(folder, entry["shard"])), entry["start"]
                rows: list[tuple] = []
                for doc_id, content in zip(np.frombuffer(reader.index, "<i8").tolist(), reader.frames()):
                    rows.append((doc_id, start, len(content) // 4, zlib.crc32(content)))
                    start += len(content) // 4
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                        rows = []
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    found = {r.shard: r.n_tokens for r in listed([(s,) for s in shards], "shard long").mapInArrow(sizes, "shard long, n_tokens long").collect()} if shards else {}  # a row a shard
    tasks, start = [], 0
    for shard in sorted(shards):
        tasks.append((shard, start))
        start += found[shard]
    return listed(tasks, "shard long, start long").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_dir(spark, "token-ids")
    manifest = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_ids(spark, folder, manifest)
