"""Level claims and tolerant JSON against position-by-position readings."""

import json
import random
import re

from kgweave.operators import evaluation as E

TELLING = ("evidence", "level", " l")


def plain_levels(t):
    out = {m[1].upper() for m in re.finditer(r"\blevel\s*[:=]?\s*(1A|1B|2A|2B|3|4)\b", t, re.I)}
    for m in re.finditer(r"\b(?:L[\s-]?)?(1A|1B|2A|2B|3|4)\b(?:\s*evidence|\s*level)?", t, re.I):
        around = " " + t[max(0, m.start() - 20) : m.end() + 20].lower()
        if any(w in around for w in TELLING):
            out.add(m[1].upper())
    return sorted(out)


def plain_json(t):
    t = re.sub(r"^\s+|\s+$", "", t)
    if t.startswith("```"):
        t = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", t))
    sums = [0]
    for c in t:
        sums.append(sums[-1] + (c == "{") - (c == "}"))
    ends = [i for i, c in enumerate(t) if c == "}" and sums[i] == 1]
    if not ends:
        return None
    blob = t[max(i for i in range(ends[0]) if t[i] == "{" and sums[i] == 0) : ends[0] + 1]
    try:
        return blob if isinstance(json.loads(blob), dict) else None
    except ValueError:
        return None


def test_levels_and_json(spark):
    rng = random.Random(71)
    a = ["level", "evidence", " ", "  ", "3", "4", "1A", "2b", "L", "L-", "L ", ":", "=", "x", "é", "lo", "word", "\n", ",", "evidenceless", "3 ", "4-", "aa bb cc", "🙂"]
    b = ["{", "}", "{}", '"a"', ":", "1", ",", "```json\n", "```", "x", "\n", '{"a": 1}', '{"b": {"c": [1, 2]}}', '"}"', " ", "{'a': 1}", '{"a": 1, "a": 2}']
    rows = [("".join(rng.choice(a) for _ in range(rng.randint(0, 40))), "".join(rng.choice(b) for _ in range(rng.randint(0, 9)))) for _ in range(1500)]
    rows += [("3 " * 2000 + "level", '{"a":' * 200 + "1" + "}" * 200), ("", ""), ("level 3", "no braces")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t string, j string")
    for r in df.select("i", E.claimed_levels("t").alias("l"), E.tolerant_json("j").alias("b")).collect():
        assert (r.l, r.b) == (plain_levels(rows[r.i][0]), plain_json(rows[r.i][1]))
    empty = spark.createDataFrame([(None, None)], "t string, j string").select(E.claimed_levels("t").alias("l"), E.tolerant_json("j").alias("b")).first()
    assert tuple(empty) == ([], None)
