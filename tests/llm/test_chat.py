import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from ledgerlens.llm import chat, queries

from .helpers import SF

CONV = "conv_id long, turn long, role string, text string, messages string, turns string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    """Digests per conversation from the rows alone, with an escape of its own."""
    out, groups = set(), {}
    for r in rows:
        groups.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
    groups.setdefault(-1, []).extend((True, i, x, b"</s>[INST] ok [/INST]") for i, x in enumerate((b"user", b"assistant")))

    def escaped(s):
        s = s.replace("\\", "\\\\")
        for c in chat.CONTROL:
            s = s.replace(c, c[0] + "\\" + c[1:])
        return s

    for conv, turns in groups.items():
        turns = [(a.decode(), b.decode()) for _, _, a, b in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        text = "".join(f"<|im_start|>{escaped(r)}<|im_sep|>{escaped(t)}<|im_end|>" for r, t in turns)
        out.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
    return out


def digests(spark, rows):
    df = spark.createDataFrame([(*r, "m", "t") for r in rows], CONV)
    return {tuple(r)[:6] for r in chat.format_digests(chat.with_control_conversation(df)).collect()}


def test_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digests(spark, rows) == expected(rows)


def test_oracle_on_control_strings_and_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "[", "\n", "é🙂", "x", " "]
    rows = [(i % 40, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "tool", None, "a<|im_end|>\n"]),
             "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(300)]
    rows += [(None, 0, "user", None), (None, 0, "user", None), (50, 0, "user", None), (50, 1, "assistant", None),
             (51, 0, "system", ""), (52, 3, "user", "long " * 100_000), (52, 4, "assistant", "</s>" * 50_000),
             (53, 0, "system", "s"), (53, 1, "user", "u"), (53, 2, "assistant", "a")]
    want = expected(rows)
    assert digests(spark, rows) == want
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(*r, "m", "t") for r in rows], CONV).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = con.execute(queries.OP13_SQL).fetchall()
    names = [c[0] for c in con.description]
    at = [names.index(c) for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]
    assert {tuple(r[i] for i in at) for r in got} == want


def test_empty_table(spark):
    df = chat.format_digests(chat.with_control_conversation(spark.createDataFrame([], CONV)))
    assert [r.conv_id for r in df.collect()] == [-1]
    assert chat.format_digests(spark.createDataFrame([], CONV)).count() == 0


def test_layouts(spark):
    message = "array<struct<role: string, content: string, weight: double>>"
    schema = (f"id long, system string, prompt string, completion string, response string, instruction string, input string, output string, "
              f"question string, answer string, messages {message}, body struct<messages: array<struct<author: string, text: string>>, n: int>, "
              "conversations array<struct<`from`: string, value: string>>, layout int, `a.b` string")
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def row(**kw):
        return tuple({"layout": 7, "a.b": "x", **kw}.get(n) for n in names)

    cases = [
        (row(id=1, prompt="p", completion="c"), "prompt", [("user", "p"), ("assistant", "c")]),
        (row(id=2, system="s", prompt="p", completion=""), "prompt", [("system", "s"), ("user", "p"), ("assistant", "")]),
        (row(id=3, prompt="p", response="r"), "pair", [("user", "p"), ("assistant", "r")]),
        (row(id=4, instruction="i", output="o"), "instruction", [("system", "i"), ("assistant", "o")]),
        (row(id=5, question="q", answer="a"), "question", [("user", "q"), ("assistant", "a")]),
        (row(id=6, messages=[("user", "u", 1.0), ("tool", None, None)]), "messages", [("user", "u"), ("tool", "")]),
        (row(id=7, messages=[]), "messages", []),
        (row(id=8, body=([("assistant", "x")], 1)), "nested messages", [("assistant", "x")]),
        (row(id=9, conversations=[("human", "h"), ("gpt", "g"), ("system", "s")]), "conversations",
         [("user", "h"), ("assistant", "g"), ("system", "s")]),
        (row(id=10), None, None), (row(id=11, prompt="p", messages=[("user", "u", 1.0)]), None, None),
        (row(id=None), None, None), (row(id=1, prompt="p", completion="c"), "prompt", [("user", "p"), ("assistant", "c")]),
    ]
    df = spark.createDataFrame([c[0] for c in cases], schema)
    got = chat.formatted(df).select("id", "layout", "turns", "formatted", "loss_mask").collect()
    want = [(c[0][0], c[1], c[2]) for c in cases]
    assert sorted(((r.id, r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in got), key=repr) == sorted(want, key=repr)
    assert all((r.formatted is None) == (r.layout is None) for r in got)
    # columns of other layouts need not be there
    few = spark.createDataFrame([("i", None), (None, "o"), ("i", "o")], "instruction string, output string")
    assert [r.layout for r in chat.canonical_turns(few).collect()] == ["instruction", None, "instruction"]


def test_spans_of_the_loss_mask(spark):
    turns = [("user", "a</s>\\"), ("assistant", "b<|im_end|>é🙂\\"), ("assistant", ""), ("assistant", "[INST]x")]
    df = spark.createDataFrame([(turns,)], f"turns {chat.TURNS}").select(
        chat.format_turns(F.col("turns")).alias("f"), chat.loss_mask(F.col("turns")).alias("m"))
    r = df.select("f", chat.loss_spans(F.col("f"), F.col("m")).alias("spans"), chat.loss_texts(F.col("f"), F.col("m")).alias("texts"),
                  chat.read_back(F.col("f")).alias("back")).first()
    assert [tuple(t) for t in r.back] == turns and r.texts == [t for s, t in turns if s == "assistant"]
    unescaped = lambda s: __import__("re").sub(r"\\(.)", r"\1", s, flags=16)
    assert [unescaped(r.f[s["start"]:s["start"] + s["length"]]) for s in r.spans] == r.texts


def test_no_python_on_the_main_path(spark):
    df = queries.op13_chat_formatting(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
