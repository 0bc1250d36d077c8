"""Tokens, packing, archives, chat format and top-k against the library, round trips and brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import bpe, chat, packing, queries, token_counts, topk, warc
from tablewright.llm.common import documents
from tablewright.session import scratch_path

from .helpers import doc_frame, edge_rows, prose

PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n=3000):
    rng = random.Random(2)
    pool = ["the", "'s", "'T", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "é", "é", "²", "Ⅷ", "中文", " ", " ", "\n",
            "\x1c", "\x00", "\U0001f600", "don't", "we'll", "’", " ", "ﬁ", "ǅ", "Å", "12", "٣", "_", "@@@", "<|", "''s", "​", "ẞ", "\x85", "Ʉ", "aƟ", "Ⱥb", "J\u030c", "Ɓ"]
    return ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_bpe_equals_library(spark, sf, library):
    texts = [*odd_texts(), *(r.text for r in documents(spark, sf).collect()), *(t for _, t, _, _ in edge_rows())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = {r.doc_id: r for r in bpe.coded_rows(docs, PATH).collect()}
    counted = {r.doc_id: r for r in token_counts.counted_rows(docs, PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert coded[i].n_tokens == counted[i].n_tokens == len(ids), repr(text)[:80]
        assert coded[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(decoded).hexdigest()
        assert counted[i].n_bytes == len((text or "").encode()) and counted[i].over_limit == (len(ids) > 2048)
    assert len(coded) == len(counted) == len(texts)


def test_backtracking_on_random_words(library):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["a" * 500]
    _, encoder, _ = bpe.coder(PATH)
    assert all(encoder.encode_word(w) == library.encode(w, add_special_tokens=False).ids for w in words)


def test_pieces_and_batches_are_whole():
    text = prose(1, 5000)
    assert "".join(token_counts.pieces(text, 1000)) == text and len(token_counts.pieces(text, 1000)) > 10
    assert token_counts.pieces("x" * 5000, 1000) == ["x" * 5000]
    items = [(i, "y" * (i * 37 % 900)) for i in range(200)]
    batches = token_counts.balanced(items, 5000)
    sizes = [sum(len(p) for _, p in b) for b in batches]
    assert Counter(x for b in batches for x in b) == Counter(items) and max(sizes) - min(sizes) < 900


def check_packing(rows, ids_of):
    documents_, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents_[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(documents_[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    return sequences


def test_packing_is_whole_and_unpadded(spark, sf, library):
    docs = documents(spark, sf)
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    for block in (packing.BLOCK_TOKENS, 5000):
        check_packing(packing.packed_rows(docs, PATH, block).collect(), ids)
    edge = packing.packed_rows(doc_frame(spark, edge_rows()), PATH).collect()
    assert sum(r.length for r in edge) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in edge_rows())


def test_step_groups_are_even():
    rng = random.Random(6)
    packed = packing.pack([rng.randint(1, 9000) for _ in range(4000)])
    groups = packing.step_groups(packed, 32)
    cost = defaultdict(list)
    for (tier, window), group in zip(packed, groups):
        cost[group].append((tier, sum(p[2] ** 2 for p in window)))
    assert all(len({t for t, _ in g}) == 1 and len(g) <= 32 for g in cost.values())
    top = [sum(c for _, c in g) for g in cost.values() if g[0][0] == 4096 and len(g) >= 31]
    assert max(top) < 1.25 * min(top)


# ---- archives ------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, code string, refers_to string"


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}\r\nx", h) for i, h in enumerate(["same"] * 40 + ["", None, "", "é\r\n\r\nWARC/1.1", "x" * 3_000_000, "alone"])]
    rows += [(3, "http://h/3", "same"), (None, None, "same"), (None, None, "lonely")]
    pages = spark.createDataFrame([(*r, "c", "r") for r in rows], PAGES)
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        raw, holder = (html or "").encode(), last[html or ""]
        back = None if holder in (i, -1) else holder
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if back is None else "revisit", back))
    assert Counter(map(tuple, warc.archived_rows(pages).collect())) == Counter(want)
    assert not any(r.refers_to is not None for r in warc.archived_rows(pages, least_bytes=10).collect())
    assert warc.archived_rows(pages.limit(0)).count() == 0


def test_records_are_found_by_frame_and_offset(spark, sf):
    folder = scratch_path(spark, "test-bundles")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write_bundles(pages, folder, bundle_bytes=20_000, frame_bytes=5_000)
    bundles = warc.read_files(spark, folder)
    places = warc.record_map(bundles)
    assert places.count() == pages.count() and bundles.count() > 1
    wanted = places.filter(F.col("record_id").isin("<urn:page:3>", "<urn:page:7>"))
    html = {f"<urn:page:{r.page_id}>": r.html for r in pages.collect()}
    got = {r.record_id: warc.parse(bytes(r.record)) for r in warc.fetch(bundles, wanted).collect()}
    assert len(got) == 2 and all(payload.decode() == (html[name] or "") for name, (_, _, payload) in got.items())
    import zstandard

    raw = bytes(bundles.first().content)
    frames = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()  # any reader skips map and table
    assert frames.startswith(b"WARC/1.1\r\n")


# ---- chat ----------------------------------------------------------------------------------------


def test_chat_round_trip(spark, sf):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, None, None, None), (2, 0, "assistant", "<|end|>\n<|turn|>x\\<|says|>\\"), (2, 0, "user", "a\nb"),
            (2, 0, "user", "a\nb"), (None, 3, "ro\nle", ""), (3, 5, "assistant", "\U0001d504" * 3)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.conversation_rows(frame).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in turns).encode()).hexdigest()
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(turns), digest, len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.conversation_rows(frame.limit(0)).count() == 0
    assert queries.chat_format(spark, sf).filter("conv_id = -7").first().n_turns == 2


def test_chat_attachments(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "i1", 56, 57, None, None), ("audio", None, "a1", None, None, 0.1, None),
             ("document", None, "d1", None, None, None, None), ("odd", "plain", None, None, None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", []), (1, 2, "tool", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.formatted(turns).first()
    assert [(a.type, a.ref, a.place, a.tokens) for a in r.attachments] == [("image", "i1", 1, 6), ("audio", "a1", 2, 3), ("document", "d1", 3, 1)]
    assert r.attachment_tokens == 10
    assert r.segments[0].segment == "<|turn|>user<|says|>see <\\|image|>" + "<|image|>" * 6 + "<|audio|>" * 3 + "<|document|>plain<|end|>\n"
    assert r.text == "".join(s.segment for s in r.segments)
    halves = [("text", t, None, None, None, None, None) for t in ("a<", "", "|turn|>b", "|c")]
    split = spark.createDataFrame([(1, 0, "user", halves)], turns.schema)
    assert [t.text for t in chat.read_back(chat.formatted(split)).first().turns] == ["a<|turn|>b|c"]


# ---- top-k ---------------------------------------------------------------------------------------


def plain_top(rows, k=5):
    usable = [(i, [int(np.floor(float(x) * 256)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, v in usable:
        first[i] = min(first.get(i, v), v)
    out = []
    for q, v in first.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in first.items() if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_top_k_equals_brute_force(spark, shard_rows):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(500)]
    rows += [(i, [1.5, 1.5, 0.0, 1.5]) for i in range(500, 900)]  # a hot vector
    rows += [(900, None), (950, [1.0, None]), (1000, [float("nan")]), (1050, []), (1100, [float("inf")]), (None, [1.0]), (1150, [2.0]), (50, [9.0] * 4), (1200, [3.0] * 4), (1200, [3.0] * 4)]
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, query_id string, shard int")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_rows=7 if shard_rows == 60 else 2048)
    assert sorted(map(tuple, got.collect())) == plain_top(rows)


def test_top_k_small_and_large_values(spark):
    schema = "vec_id long, embedding array<double>"
    query = F.col("vec_id") % 50 == 0
    assert topk.top_k(spark.createDataFrame([], schema), query).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), query).count() == 0
    huge = [(0, [1e300, -1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [2.0**40, 1.0])]
    got = topk.top_k(spark.createDataFrame(huge, schema), query).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 3, 2] and max(r.score for r in got) == 2**63 - 1


def test_packed_blocks_and_trees_are_not_broadcast(spark):
    """They are megabytes a row; size estimates from their schema would put whole waves on the driver."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(-99, 99, 4)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    waves, original = [], topk._wave

    def seen(*args):
        waves.append(original(*args))
        return waves[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(topk, "_wave", seen)
        found = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=3, scale=1, shard_rows=64, block_rows=4).collect()
    assert waves
    for wave in waves:
        plan = wave._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [shard" in plan and "BroadcastHashJoin [shard" not in plan
    x = np.array([r[1] for r in rows]).astype(np.int64)
    for query in range(0, 300, 20):
        score = x @ x[query]
        want = [i for i in np.lexsort((np.arange(300), -score)) if i != query][:3]
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query] == want


def test_narrow_types_hold_every_component():
    for top in (5, 2**15 - 1, 2**15, 2**31, 2**62):
        vectors = np.array([[top, -top]], np.int64)
        assert (topk._narrow(vectors).astype(np.int64) == vectors).all()
    assert topk._narrow(np.zeros((0, 3), np.int64)).shape == (0, 3)
