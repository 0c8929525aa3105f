"""Phrase mining, fill-in-the-middle and chat formatting against brute force."""

import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, fim, phrases
from strandline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
rng = random.Random(3)
FIELDS = "doc_id long, text string, lang string, row string, fim string, phrase string, n string, a string, hash string, kind string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def table(spark, texts, repeat=True):
    """Rows with columns of every name that the operators use themselves, nulls in any column, repeated rows."""
    rows = [(i, t, [None, "en", "fr"][i % 3], *"rfpnahk") for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, *[None] * 7)] + [rows[0], rows[-1]] * repeat
    return spark.createDataFrame(rows, FIELDS).repartition(3)


# ---- fill-in-the-middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def fim_by_hand(doc_id, text):
    text = text or ""
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    ends = [0] + [m.end() for m in UNIT.finditer(text)]
    n = len(ends) - 1
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", " ", "a", "A<P", "<S>", "x <M> y", "<<P>", "ends<", "<", "S>P>", "abc DEF ghi", "éàü ß", "👍🏽 ok", "\n\t\x00", "z" * 500, "1" * 500, "word " * 300, "<P" * 40]


def test_fim(spark):
    long = "".join(rng.choice(["alpha", " ", "é", "<", "👍", "Z", "\n"]) for _ in range(40_000))
    texts = TEXTS + [long, long[:70_000], "q" * 200_000, "<P>" + long, *["".join(rng.choices("ab <é", k=rng.randrange(60))) for _ in range(150)]]
    got = fim.transform(table(spark, texts)).select("row", "fim", fim.restore(F.col("fim.output"), F.col("fim.form")).alias("back"))
    got = got.collect()
    assert len(got) == len(texts) + 3
    for r in got:
        assert tuple(r.fim) == fim_by_hand(r.row.doc_id, r.row.text), r.row.doc_id
        assert r.back == (r.row.text or "")
    assert {r.row.fim for r in got} == {"f", None} and got[0].row.__fields__ == [c.split()[0] for c in FIELDS.split(", ")]
    assert {r.fim.form for r in got} == {"plain", "psm", "spm"}


def test_fim_empty_table(spark):
    assert fim.transform(table(spark, ["x"]).limit(0)).count() == 0


def test_automaton():
    """Functions of chunks compose to that of the whole text, whatever the cuts, from either state."""
    for _ in range(60):
        text = "".join(rng.choices("ab .é", k=rng.randrange(1, 60)))
        cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randrange(9)))
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        prefixes = fim.composed([fim.function_of(fim.classes(p)) for p in parts])
        assert len(prefixes) == len(parts)
        for i, (left, count) in enumerate(prefixes):
            whole = "".join(parts[: i + 1])
            assert (left, count) == fim.function_of(fim.classes(whole))
            assert count[fim.OUTSIDE] == len(UNIT.findall(whole)) and count[fim.INSIDE] == len(UNIT.findall("a" + whole)) - 1
        assert list(fim.starts(fim.classes(text), fim.OUTSIDE)) == [m.start() for m in UNIT.finditer(text)]


def test_op12(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = QUERIES["op12_fim"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n, form, a, b, out = fim_by_hand(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, a, b, sha(out), sha(texts[r.doc_id] or ""))


# ---- chat

ODD = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<<SYS>>x<</SYS>>", "ends [", "ends <", "<</s>", "[ROLE]a[SAYS]b[/ROLE]", "<s><s>", "a\n\nb", "é👍🏽", "$1 \\1", "[[INST]]", "<<<SYS>>"]
RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "</s>"}, {"role": "tool", "content": "t"}]}, "messages", [("system", "s"), ("user", "</s>"), ("tool", "t")]),
    ({"messages": [{"role": "user", "content": None}, {"role": None, "content": "x"}], "system": "S", "id": 7, "meta": {"a": [1, {"b": 2}]}}, "messages", [("system", "S"), ("user", ""), ("", "x")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "parts", [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "odd", "value": "z"}]}, "shared", [("user", "q"), ("assistant", "a"), ("odd", "z")]),
    ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\n\nit"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done", "extra": [[1]], "system": "be"}, "instruction", [("system", "be"), ("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": None, "response": "c"}, "response", [("user", ""), ("assistant", "c")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"messages": []}, "no messages", []),
    ({"prompt": "alone"}, None, None),
    ([1, 2], None, None),
    ("text", None, None),
]


def read(spark, rows, schema, record="record"):
    made = chat.convert(spark.createDataFrame(rows, schema).select("*", F.parse_json("json").alias(record)), record)
    made = chat.under_loss(made, F.col("chat.text"), F.col("chat.loss"), "loss")
    return made.select("row.id", "chat", chat.read_turns(F.col("chat.text")).alias("back"), "loss").orderBy("id").collect()


def test_layouts(spark):
    rows = [(i, json.dumps(x), "clash") for i, (x, _, _) in enumerate(RECORDS)] + [(99, None, None)]
    got = read(spark, rows, "id int, json string, chat string")
    assert len(got) == len(rows)
    for r, (_, layout, turns) in zip(got, [*RECORDS, (None, None, None)], strict=True):
        assert r.chat.layout == layout
        assert (r.chat.turns and [tuple(t) for t in r.chat.turns]) == (turns or ([] if turns == [] else None))
        if turns is None:
            assert r.chat.text is None and r.back is None and r.loss is None
        else:
            assert [tuple(t) for t in r.back] == turns and r.loss == "".join(t for role, t in turns if role == "assistant")


def test_escapes(spark):
    many = [{"messages": [{"role": rng.choice(["user", "assistant", "system", "[SAYS]", "a\\b", ""]), "content": rng.choice(ODD) + rng.choice(ODD)} for _ in range(rng.randrange(1, 9))]} for _ in range(150)]
    many.append({"messages": [{"role": ["user", "assistant"][i % 2], "content": f"{i}</s>"} for i in range(3000)]})
    many.append({"messages": [{"role": "user", "content": "x" * 3_000_000}, {"role": "assistant", "content": "[INST]" * 200_000}]})
    got = read(spark, [(i, json.dumps(x)) for i, x in enumerate(many)], "id int, json string")
    for r, x in zip(got, many, strict=True):
        turns = [(m["role"], m["content"]) for m in x["messages"]]
        assert [tuple(t) for t in r.back] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        body = r.chat.text
        for z, (role, _) in zip(r.chat.loss, turns, strict=True):
            assert role == "assistant" or not z.length
            assert not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[SAYS\]", body[z.start : z.start + z.length])


def test_paths(spark):
    x = {"a": {"b": [{"c": 1, "d e": [[True]]}], "f": 1.5}, "STRING": None, "g": [], "h": {}, "t`k": "x"}
    got = spark.createDataFrame([(json.dumps(x),)], "j string").select(chat.leaf_paths(F.parse_json("j")).alias("p")).first().p
    assert got == sorted(["STRING", "a.b[].c", "a.b[].`d e`[][]", "a.f", "g[]", "`t``k`"])
    assert len({chat.LAYOUTS.index(y) for y in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_by_conversation(spark):
    """Ties and repeated rows stay, nulls are empty, columns of other names don't matter."""
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (1, 1, "assistant", "a", None), (1, 1, "assistant", "b", "x"), (None, None, None, "n", None), (2, None, "user", "first", ""), (2, -1, "user", "next", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")
    got = {r.row.conv_id: [tuple(t) for t in r.back] for r in chat.convert(chat.by_conversation(df), "record").select("row", chat.read_turns(F.col("chat.text")).alias("back")).collect()}
    assert got == {1: [("user", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")], None: [("", "n")], 2: [("user", "first"), ("user", "next")]}
    assert chat.convert(chat.by_conversation(df.limit(0)), "record").count() == 0


def test_op13(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, coalesce(text, '') from '{SF}/conversations.parquet' order by all").fetchall()
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for c, _, role, text in rows:
        convs.setdefault(c, []).append((role, text))
    got = {r.conv_id: r for r in QUERIES["op13_chat"](spark, SF).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        r, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
        assert r.formatted_chars > sum(len(t) for _, t in turns)


# ---- phrases


def mined_by_hand(rows, longest, least, top):
    """rows: (text, lang)."""
    out = []
    for lang in sorted({x or "und" for _, x in rows}):
        f, n = Counter(), 0
        for text, of in rows:
            if (of or "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        known = {p: c for p, c in f.items() if c >= least}
        inner = {p[i:j] for p, c in known.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and known[p[i:j]] <= c}
        best = []
        for p, a in known.items():
            if len(p) > 1 and p not in inner:
                s, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), a, l, r))
        out += [(lang, i + 1, p.decode(), a, l, r, n, -s) for i, (s, _, p, a, l, r) in enumerate(sorted(best)[:top])]
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least,span", [(4, 40), (300, 1 << 20)])
def test_mine(spark, monkeypatch, least, span):
    words = ["the", "The", "of", "new", "york", "times", "ÉTÉ", "été", "x" * 30, "a\x00b", "it's", "日本"]
    texts = [None, "", " \t ", ".,;", "one", "a b. a b, a b; a b: a b! a b? a b\na b\x0ba b\x0ca b\r"] + [" ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randrange(40))).replace("of new", "of. new") for _ in range(120)]
    texts += ["new york times square " * 200, "no delimiters here " * 500]
    df = table(spark, texts)
    monkeypatch.setattr(phrases, "SPAN", span)
    want = mined_by_hand([(r.text, r.lang) for r in df.collect()], 5, least, 25)
    got = [tuple(r) for r in phrases.mine(df, least=least, top=25).select(*COLUMNS).orderBy("lang", "rank").collect()]
    assert got == want and len(want) > 3


def test_parts(monkeypatch):
    raw = b"One two\tthree. four" + b" w%d" * 50 + b"\nlast  one\n" + b"y" * 99 + b" z"
    lines = re.split(rb"[.\n]", raw.lower())
    want = Counter(tuple(w[i : i + k]) for k in (1, 5) for w in map(bytes.split, lines) for i in range(len(w) - k + 1))
    for span in (1, 5, 17, 40, 1 << 20):
        monkeypatch.setattr(phrases, "SPAN", span)
        got = Counter()
        for part, carried in phrases.parts(raw, 5):
            at = 0
            for line in part.split(b"\n"):
                ends = [at + m.start() for m in re.finditer(rb"\S+", line)]
                w = line.split()
                got.update(tuple(w[i : i + k]) for k in (1, 5) for i in range(len(w) - k + 1) if ends[i + k - 1] >= carried)
                at += len(line) + 1
        assert got == want


def test_mine_nothing(spark):
    assert phrases.mine(table(spark, ["x"]).limit(0)).count() == 0
    assert phrases.mine(table(spark, [None, "", "a b c"]), least=50).count() == 0


def test_big_scores(spark):
    """Products beyond 64 bits."""
    found = spark.createDataFrame([("en", "a b", 4 * 10**12, 0, 2), ("en", "a", 5 * 10**12, 0, 1), ("en", "b", 6 * 10**12, 0, 1)], "lang string, phrase string, a long, hash long, k int")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    r = phrases._scored(found, totals, 5).first()
    assert r.score == 1000 * 4 * 10**12 * 9 * 10**15 // (5 * 10**12 * 6 * 10**12)


def test_op11(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.sql(ORACLE_SQL["op11_phrases"] + " order by lang, rank")
    want, names = found.fetchall(), found.columns
    got = [tuple(r) for r in QUERIES["op11_phrases"](spark, SF).select(*names).orderBy("lang", "rank").collect()]
    assert got == want and np.ptp([r[names.index("rank")] for r in got]) > 5
    rows = con.sql("select text, lang from documents").fetchall()
    assert [tuple(r) for r in con.sql("select " + ", ".join(COLUMNS) + f" from ({ORACLE_SQL['op11_phrases']}) order by lang, rank").fetchall()] == mined_by_hand(rows, 5, 100, 2000)
