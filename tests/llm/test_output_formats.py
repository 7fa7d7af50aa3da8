"""Operators 1 and 6 (files of frames), 2 (chat) and 3 (counts)."""

import base64
import gc
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import chat, seekable, token_count, token_output, warc
from granary.llm.common import work_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \tb c", "word.\nNext line", "it's 'quoted' we'll", "<|endoftext|> x", "é ß 漢字 🙂", "a\x1cb \x85 c", "x" * 5000, "the " * 3000]
DOCS = "doc_id long, text string, shard string, ids_crc32 string"


def write(spark, rows, schema=DOCS):
    folder = work_dir(spark, "ids")
    manifest = token_output.write_ids(spark.createDataFrame(rows, schema).repartition(3), PATH, folder)
    return folder, manifest


def test_ids_are_the_library_s(spark):
    rng = random.Random(3)
    alphabet = ["a", "é", "B", " ", "  ", "\n", ".", "'s", "<|endoftext|>", "12", "漢", "ab", "the", " the", "***", "\r\n", "İ"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(4000)]
    library = Tokenizer.from_file(PATH)
    want = [np.array([*e.ids, 0], "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    encode = token_output.Encoder(PATH, 0)
    assert encode(pa.array(texts)) == want
    token_output.MEMO_WORDS, held = 100, token_output.MEMO_WORDS
    try:  # a memory that is full all the time
        got = [x for k in range(0, len(texts), 50) for x in encode(pa.array(texts[k : k + 50]))]
    finally:
        token_output.MEMO_WORDS = held
    assert got == want


def test_round_trip(spark):
    rows = [(k, t, "x", None) for k, t in enumerate(ODD)] + [(100, None, None, None), (100, None, None, None), (7, "again", None, None), (None, "no id", None, None)]
    folder, manifest = write(spark, rows)
    library = Tokenizer.from_file(PATH)
    got = token_output.read_ids(spark, folder, manifest).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == sorted((-(2**63) if d is None else d, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for d, t, *_ in rows)
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)
    assert token_output.read_document(folder, manifest, 2).tolist() == [*library.encode("a").ids, 0]
    assert token_output.read_document(folder, manifest, 12345) is None
    assert token_output.read_manifest(folder) == manifest
    assert sorted(map(tuple, token_output.read_ids(spark, folder, [{"shard": e["shard"]} for e in manifest]).collect())) == sorted(map(tuple, got)), "starts come from the files"


def test_memories_are_bounded_by_bytes():
    rng = random.Random(6)
    encode, count = token_output.Encoder(PATH, 0), token_count.Counter(PATH)
    for _ in range(6):  # texts without spaces, each a word of its own
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000)) for _ in range(30)] + ["a" * 70 + ".\n" + "b" * 5000 + str(k) for k in range(5)]
        got = encode(pa.array(texts))
        assert got[0] == encode.ids(texts[:1])[0] + encode.end and got[-1] == encode.ids(texts[-1:])[0] + encode.end
        assert count.words(texts[0] + " the the") == count.words(texts[0]) + 2 * count.words("the")
    for held in (encode.memo, encode.old, encode.tails, encode.lines, count.memo, count.old):
        assert all(len(w) <= 64 for w in held)


def test_idle_workers_let_go_of_the_encoder(spark):
    def encoders(batches):
        time.sleep(0.5)  # so that no worker takes two tasks
        yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, token_output.Encoder) for x in gc.get_objects())], pa.int64())], ["n"])

    write(spark, [(k, f"some words {k}", None, None) for k in range(400)])
    time.sleep(4)
    assert [r.n for r in spark.range(8, numPartitions=4).mapInArrow(encoders, "n long").collect()] == [0] * 4


def test_an_encoder_is_kept_between_uses():
    with token_output.encoder(PATH, 0) as first:
        with token_output.encoder(PATH, 0) as second:
            assert second is first
    with token_output.encoder(PATH, 0) as third:
        assert third is first
        time.sleep(3)
        with token_output.encoder(PATH, 0) as fourth:
            assert fourth is first, "let go while in use"


def test_no_documents(spark):
    folder, manifest = write(spark, [])
    assert manifest == [] and token_output.read_ids(spark, folder, manifest).count() == 0


def test_frames_are_independent_and_checked(spark):
    uri = work_dir(spark, "frames") + "/a.zst"
    writer = seekable.Writer(uri)
    contents = [b"first", b"", b"x" * 100_000, b"last"]
    for c in contents:
        writer.frame(c)
    writer.close(b"index")
    reader = seekable.Reader(uri)
    assert reader.index == b"index" and [reader.frame(k) for k in (3, 0, 1, 2)] == [contents[k] for k in (3, 0, 1, 2)] and list(reader.frames(most=10)) == contents
    raw = open(uri.removeprefix("file://"), "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(contents), "a plain reader reads the frames"
    broken = bytearray(raw)
    broken[8] ^= 1
    open(uri.removeprefix("file://"), "wb").write(broken)
    with pytest.raises(Exception):
        seekable.Reader(uri).frame(0)


def test_warc(spark):
    rows = [(3, "http://a/x y\r\nX: 1", "<p>é</p>", 1), (1, None, "<p>é</p>", 2), (5, "http://b", None, 3), (4, "http://c", "", 4), (9, "u", "long" * 200_000, 5), (9, "u2", "other", 6), (None, "u", "gone", 7)]
    folder = work_dir(spark, "warc")
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, first int").repartition(2), folder)
    got = {(r.page_id, r.payload_bytes): r for r in warc.read_warc(spark, folder, manifest).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {(3, 9): ("revisit", 1), (1, 9): ("response", None), (5, 0): ("revisit", 4), (4, 0): ("response", None), (9, 800_000): ("response", None), (9, 5): ("response", None)}
    assert got[3, 9].payload_digest == digest("<p>é</p>") and got[5, 0].payload_digest == digest("")
    found = [r for e in manifest if (r := warc.read_record(folder, e["bundle"], 1))]
    assert [r["payload"] for r in found] == ["<p>é</p>".encode()] and warc.read_record(folder, manifest[0]["bundle"], 777) is None
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), work_dir(spark, "warc")) == []


def test_small_payloads_may_all_be_responses(spark):
    folder = work_dir(spark, "warc")
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "xyz"), (4, "d", "xyz")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.read_warc(spark, folder, warc.write_warc(pages, folder, least_bytes=2)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


HARD = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST] [INST] \\[INST]", "<s><s>", "[PART image 1.1]", "a\\\\</s>\\", "", None, "<|x|>", "é🙂</s>"]


def test_chat_escapes_and_reads_back(spark):
    rows = [(1, k, role, t, "x") for k, t in enumerate(HARD) for role in ["assistant" if k % 2 else "[/INST] user"]] + [(2, 0, None, None, "x"), (3, 0, "user", "a", "x"), (3, 0, "user", "a", "x")]
    held = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string"))
    out = {r.conv_id: r for r in chat.digests(held).collect()}
    texts = [t or "" for t in HARD]
    roles = ["assistant" if k % 2 else "[/INST] user" for k in range(len(HARD))]
    assert out[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(roles, texts)).encode()).hexdigest()
    learned = "".join(t for r, t in zip(roles, texts) if r == "assistant")
    assert (out[1].loss_chars, out[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert out[2].n_turns == 1 and out[3].n_turns == 2
    text = "".join(held.filter("conv_id = 1").first().segments)
    assert text.count("</s>") == text.count("[INST]") == len(HARD), "only the template's own control strings are left"
    assert chat.digests(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png"), part("audio", ref="b.wav", tokens=30), part(None, " end")]), (1, 1, "assistant", [part("text", "ok")]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    r = chat.format_chat(df).first()
    assert r.segments[0] == "<s>[INST] user [/INST]see [PART image 1.2][PART audio 1.3] end</s>"
    assert [(a.placeholder, a.ref, a.tokens) for a in r.attachments] == [("image 1.2", "a.png", 256), ("audio 1.3", "b.wav", 30)] and r.expanded_tokens == 286
    m = r.loss[0]
    assert r.segments[m.segment][m.start : m.start + m.length] == "ok" and len(r.segments) == 3


def test_control_strings_can_not_be_forged_across_parts(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    cut = [part("text", x) for x in ("[", "PART image 9.9]", "<", "", "/s>", "<s>[IN", "ST] user [/INS", None, "T]", "\\", "[", "\\/INST]")]
    whole = "".join(p[1] or "" for p in cut)
    rows = [(1, 0, "user", cut), (1, 1, "assistant", [*cut, part("image", ref="a.png"), *cut, part("audio"), part("document")]), (1, 2, "assistant", [part("text", "")])]
    held = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART_TYPE}"))
    r, read = held.first(), held.select(chat.read_turns(F.col("segments")).alias("turns"), chat.read_loss(F.col("segments"), F.col("loss")).alias("loss")).first()
    text = "".join(r.segments)
    assert text.count("</s>") == text.count("[/INST]") == 3 and text.count("[PART ") == 3 == len(r.attachments)
    assert read.turns[0].text == whole and read.loss == [whole, whole, ""], "placeholders aren't learned"


def greedy(word: bytes, vocabulary: set[bytes]) -> int:
    at = n = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 1
        at += size
        n += 1
    return n


def test_automaton_counts_like_greedy_search():
    rng = random.Random(8)
    for _ in range(300):
        vocabulary = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = token_count.Automaton(sorted(vocabulary))
        for _ in range(40):
            word = bytes(rng.choices(b"abcd", k=rng.randint(0, 12)))
            assert automaton.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_counts(spark):
    rows = [(1, "a tea", 0), (2, None, 0), (3, "", 0), (4, " \n ", 0), (5, "naïve 漢字 " * 2000, 0), (5, "x", 0)]
    got = sorted((r.doc_id, r.n_words, r.n_tokens) for r in token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect())
    vocabulary = set(token_count.byte_level(PATH))
    count = lambda t: sum(greedy(b" " + w.encode(), vocabulary) for w in t.split())
    assert got == sorted((d, len((t or "").split()), count(t or "")) for d, t, _ in rows)
    assert token_count.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).agg(F.count("*")).first()[0] == 0
