"""Every registered query opN_ on the smallest tables, its contract columns computed by hand."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from strandline.llm import bpe, media, token_counts
from strandline.llm.queries import ORACLE_SQL, QUERIES

from test_llm import base_by_hand, stats_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def truth():
    return {d: (q, t) for d, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def by_id(spark, name, texts):
    got = rows(spark, name)
    out = {r.doc_id: r for r in got}
    assert len(got) == len(out) == len(texts) and set(out) == set(texts)
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def folded(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_op1(spark, texts):
    plain = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for d, r in by_id(spark, "op1_byte_bpe", texts).items():
        ids = plain.encode_ordinary(texts[d] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((texts[d] or "").encode()))


@pytest.mark.parametrize("name,cut", [("op2_quality", 0.3), ("op8_toxicity", 0.5)])
def test_scores(spark, texts, name, cut):
    got = by_id(spark, name, texts)
    by_text = defaultdict(set)
    for d, r in got.items():
        assert r.held_out == folded(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        by_text[texts[d] or ""].add(r.score)
    assert all(len(v) == 1 for v in by_text.values())


def test_op3(spark, texts):
    for d, r in by_id(spark, "op3_gif", texts).items():
        raw = (texts[d] or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), sha(full), zlib.crc32(full[-64:]))
        gif = media.encode_gif(full)
        shown = list(media.decode_gif(gif))
        assert (r.media_bytes, r.media_sha256) == (len(gif), sha(gif)) and r.feature.split(";")[0] == str(len(shown))


def test_op4(spark, texts):
    got = by_id(spark, "op4_sharding", texts)
    slots, places = defaultdict(list), defaultdict(list)
    for d, r in got.items():
        raw = (texts[d] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        places[raw].append(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))
    sizes = [sum(r.size for r in got.values() if r.shard == k) for k in range(40)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got.values())
    assert all(max(v) - min(v) <= 1 for v in places.values())


def test_op5(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.execute(ORACLE_SQL["op5_ngram_join"]).fetchall()}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows(spark, "op5_ngram_join")} == want


def test_op6(spark, texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, places, got = defaultdict(list), defaultdict(list), defaultdict(list)
    for d, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        ends = range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            want[d].append((k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    for r in rows(spark, "op6_packing"):
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(v) for d, v in got.items()} == want
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 2048
    assert len(places) <= 1.02 * sum(n for v in want.values() for *_, n, _ in v) / 2048 + 1


def test_op7(spark, texts):
    for d, r in by_id(spark, "op7_pii", texts).items():
        base = base_by_hand(texts[d] or "")
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        assert r.base_sha256 == sha(base.encode()) and set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in ("email", "ip", "card", "phone"))
        assert all(re.fullmatch(r"(email|ip|card|phone):\d+:\d+", s) for s in r.spans.split(",") if s)


def test_op9(spark, texts):
    c = token_counts.counter(P.path("piece_bpe_32k.model"))
    for d, r in by_id(spark, "op9_token_counts", texts).items():
        assert r.n_tokens == c.count(texts[d] or "")[0]


def test_op10(spark, texts):
    for d, r in by_id(spark, "op10_quality_rules", texts).items():
        n, chars, symbols, lines, repeated = stats_by_hand(texts[d])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        failed = n < 50 or 100 * repeated > 50 * n
        assert r.base_failed == failed and (not r.kept if failed else r.kept == (r.rule is None))
