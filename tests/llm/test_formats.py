"""Chat formatting, vector codes and fill-in-middle against brute force, and their SQL."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.llm import chat, codes, fim, queries

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_vector_codes", "op13_fill_in_middle"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    at = sorted(got.columns)
    assert sorted(want.columns) == at
    order = lambda rows: sorted(map(str, rows))
    assert order(tuple(r[k] for k in at) for r in got.collect()) == order(want.select(*at).fetchall())


def test_batches_are_bounded_in_bytes(spark, monkeypatch):
    """A batch of long texts holds fewer rows than one of short ones."""
    import pyarrow as pa

    from stockweave.llm import frames

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    monkeypatch.setattr(frames, "BATCH_BYTES", 1 << 20)
    long = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    got = frames.arrow(long, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 200 and max(r["size"] for r in got) < 2 << 20


# --- chat


CONTROL = ["\\", "#", "##", "###", "### ", " ", ":", ": ", "</turn>", "</", "turn>", "\n", "é", "😀", "x", "<", "assistant"]


def chat_rows():
    r = random.Random(4)
    text = lambda: None if r.random() < 0.05 else "".join(r.choice(CONTROL) for _ in range(r.randint(0, 12)))
    rows = [(r.randint(0, 60), r.randint(0, 9), r.choice(["user", "assistant", None, text(), text()]), text()) for _ in range(500)]
    return [*rows, (None, 1, "user", "x"), (3, None, "system", "y"), rows[0], rows[0], (70, 1, "assistant", "long " * 100_000)]


def escaped(s):
    return re.sub("#(?=#)", r"#\\", s.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")


def brute_chats(rows):
    out = []
    null_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: [null_first(v) for v in x[1:]])
        own = [(a or "", b or "") for _, _, a, b in own]
        whole = "".join(f"### {escaped(a).replace(': ', ':' + chr(92) + ' ')}: {escaped(b)}</turn>\n" for a, b in own)
        loss = "".join(b for a, b in own if a == "assistant")
        out.append((c, len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss), len(whole)))
    return sorted(out, key=str)


def test_chats_equal_brute_force(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat.log_of_conversations(df)
    twice = log.unionByName(log.filter("sequence % 3 = 0"))  # events that are delivered again
    for events in (log, twice):
        got = sorted(map(tuple, chat.digests(chat.format_chats(events)).collect()), key=str)
        assert got == brute_chats(rows)


def test_loss_mask_covers_the_learned_texts(spark):
    rows = chat_rows()
    done = chat.format_chats(chat.log_of_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), ("assistant", "user"))
    total = 0
    for r in done.collect():
        pieces = r.formatted.split("</turn>\n")
        for s in r.loss:
            assert r.formatted[s.start : s.start + s.length] == pieces[s.turn][s["at"] :]
            total += s.length
    assert total == sum(len(escaped(t or "")) for _, _, role, t in rows if role in ("assistant", "user"))


def test_events_are_folded_by_sequence(spark):
    events = [
        ("a", 1, 1, "delta", "user", "He"), ("a", 2, 1, "delta", None, "llo"), ("a", 5, 2, "delta", "assistant", "wrong"), ("a", 6, 2, "regenerate", "assistant", "ignored"),
        ("a", 7, 2, "delta", "assistant", "ri"), ("a", 8, 2, "delta", "assistant", "ght"), ("a", 9, 1, "edit", "user", "Bye"), ("a", 10, 1, "delta", "user", "!"), ("a", 10, 1, "delta", "user", "!"),
        ("a", 12, 3, "regenerate", "assistant", None), ("b", 4, 1, "edit", "user", "x"), ("b", 3, 1, "delta", "user", "late"), (None, None, None, None, None, None),
    ]
    log = spark.createDataFrame(events, "conversation string, sequence long, message long, kind string, role string, text string").withColumn("events", F.lit("clash")).repartition(4)
    got = {(r.conversation, r.message): (r.role, r.text) for r in chat.messages(log).collect()}
    assert got == {("a", 1): ("user", "Bye!"), ("a", 2): ("assistant", "right"), ("a", 3): ("assistant", ""), ("b", 1): ("user", "x"), (None, None): ("", "")}
    whole = {r.conversation: r.formatted for r in chat.format_chats(log).collect()}
    assert whole == {"a": "### user: Bye!</turn>\n### assistant: right</turn>\n### assistant: </turn>\n", "b": "### user: x</turn>\n", None: "### : </turn>\n"}
    assert chat.digests(chat.format_chats(log.limit(0))).count() == 0


def test_a_log_is_shuffled_once(spark, tmp_path):
    chat.log_of_conversations(chat.probe(spark)).write.parquet(f"{tmp_path}/log")
    plan = chat.format_chats(spark.read.parquet(f"{tmp_path}/log"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Python" not in plan and "Arrow" not in plan


# --- vector codes


@pytest.mark.parametrize("width", [1, 2, 4, 5, 16])
@pytest.mark.parametrize("size", [3, 50, 1 << 25, 1 << 70])
def test_nearest_entries_equal_all_distances(width, size):
    r = random.Random(width)
    kind = np.int64 if size < 1 << 30 else object
    x = np.array([[r.randint(-size, size) for _ in range(width)] for _ in range(300)], kind)
    c = np.concatenate([x[:40], x[10:34], x[:5] + 1])
    entry, distance = codes.nearest(x, c)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert distance.tolist() == every.min(axis=1).tolist() and entry.tolist() == [row.index(min(row)) for row in every.tolist()]


def brute_codes(rows):
    kept = [(i, [math.floor(256 * float(np.float32(v))) for v in x], label) for i, x, label in rows if x is not None and len(x) == 32 and all(v is not None and math.isfinite(v) for v in x)]
    seeds, width = sorted({i: x for i, x, _ in sorted(kept, key=lambda k: k[1], reverse=True)}.items())[:64], 2
    books = [[x[p * width :][:width] for _, x in seeds] for p in range(16)]
    near = lambda y, c: min((sum((a - b) ** 2 for a, b in zip(y, e)), k) for k, e in enumerate(c))
    for _ in range(2):
        members = [{} for _ in books]
        for _, x, _ in kept:
            for p in range(16):
                y = x[p * width :][:width]
                members[p].setdefault(near(y, books[p])[1], []).append(y)
        books = [[[sum(z) // len(z) for z in zip(*members[p][k])] if k in members[p] else e for k, e in enumerate(books[p])] for p in range(16)]
    out, by_label = [], {}
    for i, x, label in kept:
        found = [near(x[p * width :][:width], books[p]) for p in range(16)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = sha(",".join(str(v) for part in books for e in part for v in e))
    return sorted((i, c, e, by_label[label], digest) for i, c, e, label in out)


@pytest.mark.parametrize("n", [30, 400])
def test_codes_equal_brute_force(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, [float(v) for v in r.normal(0, 0.3, 32)], int(i % 5) if i % 7 else None) for i in range(n)]
    rows += [(1000, None, 1), (1001, [math.nan] * 32, 1), (1002, [None] + [1.0] * 31, 2), (-5, [math.inf] * 32, 1), (1003, rows[0][1], 9), (1004, [1.0] * 31, 1), (1005, [], 1), (0, rows[5][1], 3), rows[3]]
    rows += [(2000 + i, rows[1][1], 77) for i in range(n)]  # a label of many rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect())) == brute_codes(rows)


def test_codes_pass_columns_and_decode(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r.integers(-9, 9, 16)], f"c{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, own string, entry int").withColumn("error", F.lit("clash"))
    books = codes.train(df)
    got = codes.encode(df, books).withColumn("back", codes.decode(F.col("code"), books))
    assert got.columns == ["vec_id", "own", "entry", "code", "error", "back"]
    for x in got.collect():
        assert x.error == sum(int(256 * (a - b)) ** 2 for a, b in zip(x.back, rows[x.vec_id][1])) and x.own == rows[x.vec_id][2]
    huge = spark.createDataFrame([(1, [1e20] * 16), (2, [-1e20] * 16), (3, [0.0] * 16), (4, [1e40] * 16)], "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    assert {x.vec_id: x.error for x in codes.compress(huge).collect()} == {1: 0, 2: 0, 3: 0}
    assert codes.compress(huge.limit(0)).count() == 0


# --- fill in the middle


def brute_fim(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc is None else doc}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc, len(units), form, *sizes, sha(output), sha(text))


@pytest.mark.parametrize("steps", [1, 7, 64])
def test_middles_equal_brute_force(spark, monkeypatch, steps):
    monkeypatch.setattr(fim, "STEPS", steps)
    r = random.Random(steps)
    alphabet = ["a", "P", "S", "M", "<", ">", "é", "日", "😀", " ", "\n", "<P>", "<S", "Z", "9", " "]
    rows = [(i, "".join(r.choice(alphabet[: 11 if i % 3 else 16]) for _ in range(r.randint(0, 30)))) for i in range(1500)]
    rows += [(5000, None), (None, "ab c"), (5001, ""), (5002, "x é" * 100_000), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("h0", F.lit("own")).withColumn("Form", F.lit("replaced"))
    done = fim.transform(df)
    assert done.columns == ["doc_id", "text", "h0", "n", "form", "prefix_chars", "middle_chars"] and {x.h0 for x in done.select("h0").collect()} == {"own"}
    assert sorted(map(tuple, fim.digests(done).collect()), key=str) == sorted((brute_fim(*x) for x in rows), key=str)
    assert fim.digests(fim.transform(df.limit(0))).count() == 0


def test_lanes_need_the_tables_memory_only():
    r = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 3000):
        text = r.choice(np.frombuffer("aPSM<>éß日😀 \n".encode(), np.uint8), size)
        state, want = 0, []
        for b in text.tolist():
            at = state * len(fim.KINDS) + int(fim._KIND_OF[b])
            want.append(at)
            state = int(fim._NEXT[at]) // len(fim.KINDS)
        assert fim.transitions(text).tolist() == want
