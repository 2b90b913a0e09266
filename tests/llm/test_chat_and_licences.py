"""Tool-call linking and licence scans."""

import json
import math
import random
import re
import textwrap
from collections import Counter

from quern.llm.license_scan import HEADERS, IDENTIFIERS, all_templates, inherited, scan, scan_documents, whole_texts
from quern.llm.tool_calls import answers, canonical, chat_lines, levels, link
from tests.llm.helpers import awkward, nothing

CALLS = "conv_id long, turn long, pos int, call_id string, name string, arguments string, depends_on array<string>, extra string"
TOOLS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}


def test_links_validates_and_orders(spark):
    calls = spark.createDataFrame(
        [
            (1, 2, 0, "x", "add", '{"b": 2.5, "a": 1}', None, "e"),
            (1, 2, 1, "y", "add", '{"a": "1", "b": 2}', ["x"], "e"),
            (1, 2, 2, "z", "add", '{"a": 1, "b": 2, "c": 3}', ["y", "x"], "e"),
            (1, 4, 0, "w", "add", '{"a": 1, "b": 2, "note": "é\\n"}', ["x", "gone"], "e"),
            (1, 6, 0, "p", "add", "[1]", ["q"], "e"),
            (1, 6, 1, "q", "other", "{}", ["p"], "e"),
            (2, 1, 0, None, "add", "not json", ["w"], "e"),
            (None, 1, 0, "x", None, None, None, None),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, 3, "x"), (1, 5, "x"), (1, 3, "z"), (1, 3, "nobody"), (1, 7, None)], "conv_id long, turn long, call_id string")
    found = {(r["conv_id"], r["call_id"]): r for r in link(calls, results, TOOLS, ("extra",)).collect()}
    assert len(found) == 8
    assert [found[1, k]["result_turn"] for k in "xyzw"] == [3, None, 3, None]
    assert [found[1, k]["level"] for k in "xyzwpq"] == [0, 1, 2, 0, None, None]
    assert [found[1, k]["unmet"] for k in "xyzw"] == [False, False, False, True]
    assert [found[1, k]["valid"] for k in "xyzwpq"] == [True, False, False, True, False, False]
    assert found[1, "x"]["arguments"] == '{"a":1,"b":2.5}' and json.loads(found[1, "w"]["arguments"])["note"] == "é\n"
    assert found[2, None]["arguments"] is None and found[1, "x"]["extra"] == "e"
    assert Counter((r["turn"], r["call_id"], r["linked"]) for r in answers(calls, results).collect()) == Counter([(3, "x", True), (5, "x", False), (3, "z", True), (3, "nobody", False), (7, None, False)])
    assert link(calls.filter("turn > 9"), results, TOOLS).count() == 0 and levels(calls.filter("turn > 9")).count() == 0


def test_chat_lines(spark):
    rows = [(1, 0, "system", "s"), (1, 2, "user", 'q "1"\n'), (1, 3, "assistant", "a"), (1, 4, "user", None), (1, 7, "assistant", "late"), (2, 0, None, "x"), (None, 0, "user", "n"), (3, 1, "user", "twice"), (3, 1, "user", "twice"), (3, 2, "assistant", "r"), (4, 0, "user", "round")]
    table = spark.createDataFrame([(*r, "c", True) for r in rows], "conv_id long, turn long, role string, text string, call_id string, linked boolean")
    found = chat_lines(table).collect()
    assert len(found) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in found}
    q = '"q \\"1\\"\\n"'
    assert by[1, 2]["line"] == f'{{"calls":[{{"arguments":{{"text":{q}}},"id":"1-2-split","name":"split"}},{{"arguments":{{"chars":6,"text":{q}}},"id":"1-2-count","name":"count"}},{{"arguments":{{"draft":true,"prompt":{q},"turn":2}},"id":"1-2-reply","name":"reply"}}],"content":{q},"role":"user","turn":2}}'
    assert (by[1, 2]["valid"], by[1, 2]["unmet"], by[1, 2]["level"], by[1, 4]["unmet"]) == (False, True, 2, False)
    assert by[1, 3]["linked"] and by[1, 2]["linked"] and not by[1, 4]["linked"] and by[1, 4]["valid"] is False and not by[1, 7]["linked"]
    assert by[2, 0]["line"] == '{"content":"x","turn":0}' and by[None, 0]["call_id"] is None and by[None, 0]["line"].count('"id"') == 0
    assert sum(r["conv_id"] == 3 and r["linked"] for r in found) == 3 and by[3, 1]["valid"]
    assert by[4, 0]["level"] is None and [c["name"] for c in json.loads(by[4, 0]["line"])["calls"]] == ["split", "reply", "count"]
    assert chat_lines(table.filter("turn > 9")).count() == 0


def test_lines_hold_what_canonical_returns(spark, monkeypatch):
    from quern.llm import tool_calls

    texts = ['say "", "text":""', "", None, '{"prompt":""}', "back\\slash, é \U0001f600\n", "[]", "Infinity"]
    table = spark.createDataFrame([(c, 2, "user", t) for c, t in enumerate(texts)] + [(None, 2, "user", "n")], "conv_id long, turn long, role string, text string")
    collected = lambda: {r["conv_id"]: r["line"] for r in chat_lines(table).collect()}
    found = collected()
    for c, line in found.items():
        text, made = "n" if c is None else texts[c], json.loads(line)
        assert line == json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and made.get("content") == text and len(made["calls"]) == 3
        assert all(call["arguments"].get("prompt" if call["name"] == "reply" else "text") == text for call in made["calls"])
    # Without the stage the arguments stay as the calls gave them, spaced and out of order.
    monkeypatch.setattr(tool_calls, "canonical", lambda arguments: arguments)
    given = collected()
    assert all(given[c] != line and json.loads(given[c]) == json.loads(line) for c, line in found.items())


def test_texts_themselves_are_validated_and_made_canonical(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quern.llm import tool_calls

    table = spark.createDataFrame([(1, 8, "user", "bad one"), (1, 6, "user", "good"), (2, 4, "user", None), (3, 4, "user", "")], "conv_id long, turn long, role string, text string")
    before = {(r["conv_id"], r["turn"]): r for r in chat_lines(table).collect()}
    # In pieces of any size the lines are the same.
    monkeypatch.setattr(tool_calls, "PIECE", 3)
    pieces = {(r["conv_id"], r["turn"]): r for r in chat_lines(table).collect()}
    assert pieces == before and before[1, 6]["valid"] and before[3, 4]["valid"] and not before[2, 4]["valid"]
    monkeypatch.undo()
    # What canonical makes of a text shows in its line alone: the stage sees the text, not a place for it.
    whole = tool_calls.canonical
    monkeypatch.setattr(tool_calls, "canonical", lambda arguments: F.when(~arguments.contains("bad"), whole(arguments)))
    after = {(r["conv_id"], r["turn"]): r for r in chat_lines(table).collect()}
    assert before[1, 8]["valid"] and not after[1, 8]["valid"] and after[1, 6] == before[1, 6]
    assert all("arguments" not in call for call in json.loads(after[1, 8]["line"])["calls"])


def test_chat_lines_equal_sql(spark, small):
    from quern.llm.queries import oracle_sql, queries
    from tests.oracle import connect, same

    df = queries()["op1_chat_formatting"](spark, small)
    same(df, connect(small), oracle_sql()["op1_chat_formatting"])
    # The query meets every case: orders, cycles, missing parents, broken arguments.
    seen = df.groupBy("level", "valid", "unmet").count().filter("valid IS NOT NULL").collect()
    assert {r["level"] for r in seen} == {2, None} and {r["valid"] for r in seen} == {True, False} and {r["unmet"] for r in seen} == {False, True}


def test_long_texts_and_odd_numbers(spark):
    from pyspark.sql import functions as F

    long = spark.createDataFrame([(1, 1, "user")], "conv_id long, turn long, role string").withColumn("text", F.repeat(F.lit("x"), 21_000_000))
    row = chat_lines(long).select("valid", F.length("line").alias("n")).first()
    assert row["valid"] and row["n"] > 4 * 21_000_000
    args = ["{\"a\":1e400}", '{"a":"Infinity"}', '{"b":1,"a":[1.50,null]}', '{"\U0001f600":1,"\ufb01":2}', "nope"]
    got = [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(args)], "i int, a string").orderBy("i").select(canonical(F.col("a"))).collect()]
    assert got[0] is None and got[1] == '{"a":"Infinity"}' and got[4] is None and got[2].startswith('{"a":[1.5') and list(json.loads(got[3])) == ["\U0001f600", "\ufb01"]


def test_scan_equals_brute_force(spark):
    texts = [
        ("/a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("/a/x.py", "code\nmore code. And words of prose"), ("/a/b/y.py", "Released under the MIT License. " + "more words " * 80), ("/a/b/c/z.py", None),
        ("/q/w.py", "nothing at all"), ("/LICENSE.txt", "All rights reserved."), (None, "Licensed under CC BY 4.0."), ("/a/b/c/z.py", None), ("top", ""), ("/r/e.py", "long prose " * 500 + ". Licensed under CC BY-NC 4.0.\nend"),
    ]
    files = spark.createDataFrame([(i, p, t, "x", 1.0) for i, (p, t) in enumerate(texts)], "id long, path string, text string, license string, cosine double")
    found = {r["id"]: r for r in scan(files).collect()}
    assert len(found) == len(texts)
    # TF-IDF cosines by their definition, with nothing from the module but the templates.
    split = lambda t: re.findall(r"(?:[a-z0-9]|[.-](?=[a-z0-9]))+", (t or "").lower())
    templates = all_templates()
    vocabulary = {x for _, t in templates for x in split(t)}
    df = Counter(x for _, t in texts for x in vocabulary & set(split(t)))
    idf = lambda x: math.log((1 + len(texts)) / (1 + df[x])) + 1

    def vector(t):
        u = {x: (1 + math.log(n)) * idf(x) for x, n in Counter(split(t)).items()}
        norm = math.sqrt(sum(w * w for w in u.values()))
        return {x: w / norm for x, w in u.items()} if u else {}

    vectors = [(name, vector(t)) for name, t in templates]

    def best(unit, threshold):
        u = vector(unit)
        score, k = max((round(sum(u.get(x, 0) * w for x, w in v.items()), 9), -k) for k, (_, v) in enumerate(vectors))
        return (score, vectors[-k][0]) if score >= threshold else None

    for i, (_, t) in enumerate(texts):
        headers = [b for s in re.split(r"\n|(?<=[.!?])[ \t]+", t or "") if (b := best(s, 0.75))]
        assert found[i]["header"] == (max(headers, key=lambda b: b[0])[1] if headers else None)
        assert found[i]["file"] == ((b := best(t or "", 0.5)) and b[1])
    assert found[1]["license"] == "Apache-2.0" and found[1]["inherited_from"] == "/a" and found[2]["license"] == "MIT"
    assert found[3]["license"] == "Apache-2.0" and found[4]["license"] == "Proprietary" and found[4]["inherited_from"] == ""
    assert found[9]["header"] == "CC-BY-NC-4.0" and found[6]["inherited"] is None
    assert scan(files.filter("id > 99")).count() == 0


def test_real_licence_files_headers_and_tags(spark):
    random.seed(12)
    word = lambda: "".join(random.choice("aeioubcdrst") for _ in range(random.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}

    def add(name, body, part):
        want[len(rows)] = (name, part)
        rows.append((len(rows), f"/d{len(rows)}/f", body))

    for name, text in whole_texts():
        # As files hold them: other lines, a holder's name, some words more.
        add(name, "Copyright 2020 The Authors of " + prose(4) + "\n\n" + "\n".join(textwrap.wrap(text, 61)), "file")
        add(name, prose(12) + "\n" + text.upper(), "file")
    for name, text in HEADERS:
        lines = textwrap.wrap(text, 70)
        add(name, "# Copyright 2021 " + prose(2) + "\n#\n" + "\n".join("# " + x for x in lines) + "\n\nimport os\n" + prose(300), "header")
        add(name, "/*\n * " + "\n * ".join(lines) + "\n */\nint main() {}\n" + prose(300), "header")
    for i in IDENTIFIERS:
        add(re.sub("-(only|or-later)$", "", i), f"// SPDX-License-Identifier: {i}\n" + prose(200), "header")
    clean = range(len(rows), len(rows) + 60)
    rows += [(i, f"/d{i}/f", prose(80) + ". The software of the work is distributed with any copy. " + prose(80)) for i in clean]
    found = {r["id"]: r for r in scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    hits = {i: found[i][part] == name for i, (name, part) in want.items()}
    assert sum(hits.values()) >= 0.95 * len(hits), [(want[i], found[i]["header"], found[i]["file"]) for i, ok in hits.items() if not ok]
    assert all(found[i]["license"] is None for i in clean)


def test_nearest_ancestor(spark):
    dirs = spark.createDataFrame([("",), ("/a",), ("/a/b/c",), ("/ab",)], "directory string")
    covered = spark.createDataFrame([("/a", "L1"), ("/a/b", "L2")], "directory string, license string")
    assert {r["directory"]: r["inherited"] for r in inherited(dirs, covered).collect()} == {"/a": "L1", "/a/b/c": "L2"}


def test_scan_awkward_documents(spark):
    docs = awkward(spark)
    assert scan_documents(docs).count() == docs.count() and scan_documents(nothing(spark)).count() == 0
