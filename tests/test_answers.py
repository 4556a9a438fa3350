"""Model answers against a schema of any shape, held to a plain validator."""

import json
import random
import re

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from pagelode.functions import text, urls
from pagelode.operators import answers, model_output

PLACE = StructType([StructField("city", StringType(), False, {"pattern": "^[A-Z]"}), StructField("codes", ArrayType(LongType(), False), True, {"minimum": 1, "maximum": 2})])
SCHEMA = StructType(
    [
        StructField("title", StringType(), False),
        StructField("kind", StringType(), True, {"enum": ["full", "part"]}),
        StructField("pay", StructType([StructField("low", DoubleType(), True, {"minimum": 0.0}), StructField("open", BooleanType(), True)]), True),
        StructField("places", ArrayType(PLACE, True), True),
    ]
)
NUMBER = re.compile(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*")


def scalar(v, kind):
    """(whether it is one, its value)."""
    if isinstance(kind, StringType):
        return isinstance(v, str), v
    if isinstance(kind, BooleanType):
        low = str(v).lower() if isinstance(v, (bool, str)) else ""
        return low in ("true", "false"), low == "true"
    if isinstance(v, bool) or not isinstance(v, (int, float, str)) or (isinstance(v, str) and not NUMBER.fullmatch(v)):
        return False, None
    number = float(v)
    return (number == int(number), int(number)) if isinstance(kind, LongType) else (True, number)


def broken(v, kind, path, rules):
    if isinstance(kind, StructType):
        if not isinstance(v, dict):
            return path
        for f in kind.fields:
            x = v.get(f.name)
            found = (None if f.nullable else f"{path}.{f.name}") if x is None else broken(x, f.dataType, f"{path}.{f.name}", f.metadata)
            if found:
                return found
        return None
    if isinstance(kind, ArrayType):
        if not isinstance(v, list) or not rules.get("minimum", 0) <= len(v) <= rules.get("maximum", 99):
            return path
        for i, x in enumerate(v):
            found = (None if kind.containsNull else f"{path}[{i}]") if x is None else broken(x, kind.elementType, f"{path}[{i}]", {})
            if found:
                return found
        return None
    good, value = scalar(v, kind)
    if not good or ("enum" in rules and value not in rules["enum"]) or ("pattern" in rules and not re.search(rules["pattern"], value)) or ("minimum" in rules and value < rules["minimum"]):
        return path
    return None


def read(v, kind):
    if v is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: read(v.get(f.name), f.dataType) for f in kind.fields}
    return [read(x, kind.elementType) for x in v] if isinstance(kind, ArrayType) else scalar(v, kind)[1]


def some(rng, kind, rules):
    """Mostly what the type asks for."""
    if rng.random() < 0.06:
        return rng.choice([None, 3, "x", True, [], {}, [None], -1.5])
    if isinstance(kind, StructType):
        return {f.name: some(rng, f.dataType, f.metadata) for f in kind.fields if rng.random() > 0.08} | ({"more": [1]} if rng.random() < 0.2 else {})
    if isinstance(kind, ArrayType):
        return [some(rng, kind.elementType, {}) for _ in range(rng.choice([1, 1, 2, 2, 3, 0]))]
    if isinstance(kind, StringType):
        return rng.choice(rules.get("enum") or ["Ab", "Zz", "Q"])
    return rng.choice([True, "false", "TRUE"]) if isinstance(kind, BooleanType) else rng.choice([1, 2.0, "7", " 3 ", 4, 0]) if isinstance(kind, LongType) else rng.choice([1, 2.5, "7e1", 0, "0.5"])


def test_answers_equal_a_plain_validator(spark):
    rng, rows = random.Random(8), []
    for k in range(400):
        items = [some(rng, SCHEMA, {}) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
        whole = rng.choice([items, {"items": items}, {"items": items, "n": 1}, items[0] if items and isinstance(items[0], dict) and "items" not in items[0] else items])
        text = json.dumps(whole)
        rows.append((k, f"```json\n{text}\n```" if k % 5 == 0 else text, items if isinstance(whole, list) or "items" in whole else [whole]))
    frame = spark.createDataFrame([(k, a) for k, a, _ in rows], "k int, answer string")
    got = {r["k"]: r for r in answers.checked(frame, SCHEMA).collect()}
    good = 0
    for k, _, items in rows:
        want = next((f for i, x in enumerate(items) if (f := f"$[{i}]" if x is None else broken(x, SCHEMA, f"$[{i}]", {}))), None)
        assert got[k]["violation"] == want, (rows[k], want)
        if want is None:
            good += bool(items)
            assert [r.asDict(recursive=True) for r in got[k]["rows"]] == [read(x, SCHEMA) for x in items], rows[k]
        else:
            assert got[k]["rows"] is None
    assert good > 80


def test_answers_that_are_no_items(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "no"), (4, "3"), (5, '"x"'), (6, "[]"), (7, '{"items":[]}'), (8, '{"items":3}'), (9, "[null]"), (10, '{"title":"A"}')], "k int, answer string")
    got = {r["k"]: (r["violation"], None if r["rows"] is None else len(r["rows"])) for r in answers.checked(frame, SCHEMA).collect()}
    assert got == {1: ("$", None), 2: ("$", None), 3: ("$", None), 4: ("$", None), 5: ("$", None), 6: (None, 0), 7: (None, 0), 8: ("$[0].title", None), 9: ("$[0]", None), 10: (None, 1)}


def test_jobs_are_read_without_writing_json_and_stay_the_same(spark):
    odd = [
        '{"jobs":[{"title":"a","url":"https://j.example/1","location":"x","requirements":["r","",null]}]}', '```json\n{"jobs":[{"title":"a","url":"HTTPS://J.example:443"}]}\n```', '\u00a0{"jobs":[]}\n',
        '{"jobs":[1,null,"x",[{"title":"a"}],{"title":"","url":"https://j.example/"},{"title":5,"url":"https://j.example/"},{"title":"b","url":7},{"title":"c","url":["https://j.example/"]}]}',
        '{"jobs":[{"title":"a","url":"https://j.example/","location":3,"department":null,"description":{"x":1},"requirements":"r","salary_range":"s"}]}',
        '[{"title":"a","url":"https://j.example/"}]', '{"jobs":{"title":"a"}}', '{"jobs":null}', '{"jobs":[', "none", "3", '"x"', "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(odd)), "k int, a string")
    got = rows.select("k", model_output.jobs_of(F.col("a")).alias("j"))
    row = lambda title, url, location=None, requirements=(), salary=None: (title, url, location, None, None, None, list(requirements), salary)
    want = {0: [row("a", "https://j.example/1", "x", ["r"])], 1: [row("a", "https://j.example/")], 2: [], 3: [], 4: [row("a", "https://j.example/", None, (), "s")]}
    assert {r["k"]: None if r["j"] is None else [tuple(x) for x in r["j"]] for r in got.collect()} == {k: want.get(k) for k in range(len(odd))}
    assert "StructsToJson" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_short_ways_say_the_same(spark):
    given = ["{}", "[]", "{}\n", " {}", "{```", "```{}```", "```json\n[1]\n```", "{]", "{", "[", "", "x", None, "{\u00a0}", "```json {}"]
    given += [f"{s}://{h}{r}" for s in ("http", "https", "HTTP", "ftp") for h in ("a.b", "A.b", "a:80", "a:443", "a b", "", "a_b-c.d") for r in ("", "/", "/x?y#z", "?q", "/x\ny", "/x\n", "/x y", "/" + "x" * 2100, "/\u2028", "/\u00e9")]
    rows = spark.createDataFrame([(g,) for g in given], "c string")
    c = F.col("c")
    wrong = rows.where(~text.without_fences(c).eqNullSafe(text._unfenced(c)) | ~urls.normal(c).eqNullSafe(urls._normal(c)))
    assert wrong.collect() == []


def test_the_first_of_equal_urls_stays_across_chunks(spark):
    jobs = lambda *k: json.dumps({"jobs": [{"title": f"{t}", "url": f"https://j.example/{u}"} for t, u in k]})
    rows = spark.createDataFrame([("p", 1, jobs(("c", 2), ("d", 1)), False), ("p", 0, jobs(("a", 1), ("b", 1)), False), ("q", 0, "none", True), ("r", 0, "none", False)], "url string, chunk int, answer string, cut_off boolean")
    got = {r["url"]: (r["parse_status"], [j["title"] for j in r["jobs"]]) for r in model_output.model_listings(rows).collect()}
    assert got == {"p": ("clean", ["a", "c"]), "q": ("truncated", []), "r": ("failed", [])}
