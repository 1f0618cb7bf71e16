import base64
import hashlib
import json
import re

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.llm import chat, mixing, warc
from lectern.llm.queries import PROBE, op1_chat_format, op8_mix_sources, op10_warc_bundles, oracle_sql, queries

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_op1_equals_brute_force(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(0, "user", PROBE), (1, "assistant", PROBE)]
    got = {r.conv_id: r for r in op1_chat_format(spark, sf_dir).collect()}
    assert got.keys() == turns.keys()
    for k, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rows), sha("".join(f"{a}\n{t}\n" for _, a, t in rows)), len(loss), sha(loss))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries()[name](spark, sf_dir)
    result = con.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(names).collect())) == sorted(map(str, [Row(*names)(*r) for r in result.fetchall()]))


HARD = ["", "\\", "\\l", "\\h## ", "### user: x</turn>\n", "</turn></turn>", "#### ", "a\nb: c", "\\\\b<", "é" * 3, PROBE]


def test_round_trip_of_control_strings(spark):
    rows = [(i, [(role, text) for text in HARD]) for i, role in enumerate(["user", "assistant", "a: b\n### ", "", "</turn>"])]
    df = spark.createDataFrame(rows, f"id int, turns {chat.TURNS}")
    out = chat.format_turns(df, loss_role="assistant").withColumn("back", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        assert [tuple(t) for t in r.back] == [tuple(t) for t in r.turns]
        assert r.loss == ([t.text for t in r.turns] if r.id == 1 else [])


@pytest.mark.parametrize("kind", ["string", "variant"])
def test_layouts(spark, kind):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "q"), ("assistant", "")]),
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p", "completion": "c"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "n", "output": "o", "score": 1.5}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"question": "q", "context": "c", "answer": "a"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
        ({"prompt": "p", "prompt_id": "7", "messages": [{"role": "user", "content": "q"}]}, "messages", [("user", "p"), ("user", "q")]),
        ({"prompt": "q", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}]}, "messages", [("system", "s"), ("user", "q")]),
        ({"messages": [{"role": "user", "content": "q"}], "system": "S"}, "messages", [("system", "S"), ("user", "q")]),
        ({"conversations": [{"role": "user", "content": "q"}]}, "conversations", [("user", "q")]),
        ({"messages": [{"from": "Human", "value": "q"}, {"from": "GPT", "value": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"query": "q", "response": "r"}, "query", [("user", "q"), ("assistant", "r")]),
        ({"inputs": "q", "targets": "r"}, "inputs", [("user", "q"), ("assistant", "r")]),
        ({"input": "q", "output": "r"}, "input", [("user", "q"), ("assistant", "r")]),
        ({"data": {"messages": [{"role": "user", "content": "q"}], "id": 4}}, "data.messages", [("user", "q")]),
        ({"messages": [{"role": "assistant", "tool_calls": [1]}, {"role": "tool", "content": "42"}]}, "messages", [("assistant", ""), ("tool", "42")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}]}, "messages", [("user", "a\n\nb")]),
        ({"prompt": "p", "chosen": "good", "rejected": "bad"}, "chosen", [("user", "p"), ("assistant", "good")]),
        ({"prompt": "p", "chosen": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "rejected": []}, "chosen_messages", [("user", "p"), ("user", "q"), ("assistant", "a")]),
        ({"prompt": "p", "completion": "c", "response": "r"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"other": 1}, None, None),
        ({"messages": []}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r[0])) for i, r in enumerate(records)] + [(98, "no json"), (99, None)], "id int, record string")
    if kind == "variant":
        df = df.withColumn("record", F.try_parse_json("record"))
    got = {r.id: r for r in chat.format_records(df, "record").drop("record").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == turns
    assert {i for i, (_, layout, _) in enumerate(records) if layout is None} == {i for i in range(len(records)) if got[i].unknown_layout}
    assert "other" in got[[r[0] for r in records].index({"other": 1})].unknown_layout and got[98].unknown_layout is None
    unread = {k: r.unread for k, r in got.items()}
    assert unread[0] == ["id"] and unread[[r[0] for r in records].index({"prompt": "p", "completion": "c", "response": "r"})] == ["response"] and unread[98] is None
    assert [u for i, u in unread.items() if i < len(records) and "data" in records[i][0]] == [["data.id"]]
    assert [u for i, u in unread.items() if i < len(records) and records[i][0].get("rejected") == "bad"] == [["rejected"]]
    assert got[98].layout is None and got[99].formatted == "" and got[99].loss_spans == []


def test_struct_records_are_fingerprinted_by_schema(spark):
    df = spark.createDataFrame([(1, ("p", "c", 7)), (2, (None, "c", 7))], "id int, record struct<prompt:string,completion:string,n:int>")
    got = {r.id: r for r in chat.format_records(df, "record").collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "p"), ("assistant", "c")]
    assert [tuple(t) for t in got[2].turns] == [("user", ""), ("assistant", "c")]
    assert chat.format_records(spark.createDataFrame([(1, (2,))], "id int, record struct<a:int>"), "record").first().layout is None


def test_clashing_columns_of_records(spark):
    df = spark.createDataFrame([('{"prompt":"p","completion":"c"}', 1, 2, 3, 4)], "record string, _key int, _pieces int, _layout int, turns int")
    row = chat.format_records(df, "record").first()
    assert (row._key, row._pieces, row._layout, row.layout, len(row.turns)) == (1, 2, 3, "prompt", 2)


def test_turn_rows_edge_cases(spark):
    kind = "conv_id long, turn long, role string, text string, formatted int"
    df = spark.createDataFrame([(1, 1, None, None, 0), (1, 0, "user", "x" * 300_000, 0), (None, 0, "user", "n", 0), (2, 0, "user", "a", 0), (2, 0, "user", "a", 0)], kind)
    got = {r.conv_id: r for r in chat.format_records(chat.records_from_turn_rows(df), "record").collect()}
    assert [len(t.text) for t in got[1].turns] == [300_000, 0] and len(got[2].turns) == 2 and None in got
    assert chat.format_records(chat.records_from_turn_rows(df.limit(0)), "record").count() == 0


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        weight = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / weight for s in names}
        over = {s for s in names if s not in capped and t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def check_mix(rows):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        target[r.source] = max(target.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5 * target[s] + 1


def test_op8(spark, sf_dir):
    rows = op8_mix_sources(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) for r in rows)
    check_mix(rows)
    assert sorted(rows) == sorted(op8_mix_sources(spark, sf_dir).collect())


def test_mix_edge_cases(spark):
    kind = "doc_id long, text string, source string, size int, copies string"
    rows = [(1, None, "a", 0, ""), (2, "", None, 0, ""), (3, "x y", None, 0, ""), (4, "w " * 50_000, "b", 0, ""), (5, "q r", "c", 0, ""), (5, "q r", "c", 0, ""), (None, "n", "c", 0, "")]
    df = spark.createDataFrame(rows + [(100 + i, "p q r", "d", 0, "") for i in range(300)], kind)
    out = mixing.mix(df).withColumn("taken", F.col("copies") * F.col("size")).collect()
    assert len(out) == len(rows) + 300
    check_mix([r for r in out])
    assert len({r.copies for r in out if r.doc_id == 5}) <= 2
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("doc_id = 1")).first().copies == 0
    mixed = mixing.repeat_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)


@pytest.mark.parametrize("again", [300, 9000])
def test_mix_of_repeated_rows_is_near_its_target(spark, again):
    """One row 300 times among 450 rows of a source, and one that is over a third of the table, in more than one chunk."""
    rows = [(1, "p q r s t u v w", "a", "x")] * again + [(10 + i, "w " * (i % 40 + 1), "a", "y") for i in range(150)] + [(1000 + i, "w " * (i % 60 + 1), s, "z") for i, s in enumerate("bcd" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string").repartition(5)
    out = mixing.mix(df).withColumn("taken", F.col("copies") * F.col("size")).collect()
    assert len(out) == len(rows)
    for source, largest in (("a", 40), ("b", 60), ("c", 60), ("d", 60)):
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest
    same = sorted({r.copies for r in out if r.doc_id == 1})
    assert same[-1] - same[0] <= 1
    mixed = mixing.repeat_documents(df).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("words"), F.count("*").alias("n")).collect()
    assert {r.source: r.words for r in mixed} == {s: sum(r.taken for r in out if r.source == s) for s in "abcd"}
    assert sum(r.n for r in mixed) == sum(r.copies for r in out)


def test_op10(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    check_pages(pages, op10_warc_bundles(spark, sf_dir).collect())


def check_pages(pages, rows, least=0):
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        p = pages[r.page_id]
        revisit = len(p) >= least and first[p] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", first[p]) if revisit else ("response", None))


@pytest.mark.parametrize("least", [0, 5])
def test_warc_edge_cases_and_seeks(spark, tmp_path, least):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "u\r\nX: y", None), (4, "", ""), (5, "b", "é\r\n\r\nWARC/1.1\r\n" * 40_000), (6, "c", "longer"), (7, "c", "longer")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    folder = f"file://{tmp_path}/bundles"
    index = warc.write_bundles(warc.plan_records(df, least), folder)
    back = warc.read_bundles(index, folder)
    check_pages({r[0]: (r[2] or "").encode() for r in rows}, back.collect(), least)
    one = warc.read_records(index, folder, F.col("record_id") == 5).collect()
    assert [bytes(r.payload) for r in one] == [rows[4][2].encode()]
    assert warc.archive_and_read(df.limit(0)).count() == 0
