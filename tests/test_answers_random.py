"""Random answers, good and broken, against the meaning spelled out in Python."""

import json
import math
import random

from plumbline.fixed_values import NEGATIVE, NEGATIVE_WORDS, POSITIVE, POSITIVE_WORDS
from plumbline.operators.json_lines import explode_items
from plumbline.operators.responses import normalize_predictions

VALUES = [
    "0", "1", "2", "3", "4", "-1", "0.9", "1.0", "1.5", "2.7", "3.999", "-0.0", "1e0", "1E2",
    "12345678901", "123456789012345678901234567890", "1e10", "1e-5", "0.1e1", "true", "false",
    "null", "[]", "{}", "[0]", "[null]", '{"a": 1}', '""', '"0"', '"1"', '" 1 "', '"2"', '"+3"',
    '"-2"', '"1_0"', '"_1"', '"1__0"', '"007"', '"2.0"', '"1e2"', '"99"', '"Yes"', '"NO"',
    '"y "', '"True"', '"Normal"', '"delusional"', '"Non-Delusional"', '"\\u0031"', '"\\n1\\t"',
    '"high"', '"[]"', '"{}"', '"false"', '"r\\"q"', '"a } b { c"', '"é 　"', '"1\\u00a0"',
    "nope", "NaN", "Infinity", "'1'", "01", "+1", ".5", "1.", '"open', '"tab\tinside"',
]
KEYS = ["diagnosis", "severity", "confidence", "reasoning", "explanation", "other", "Diagnosis"]
SPACES = ["", " ", "\n", "\t ", "\r\n", "\xa0"]
AROUND = ["", "", "", " ", "　", "\x1f", "text ", "``` ", "a { b ", " } c", "{", "}", ",", "{} "]


def random_answer(chance: random.Random) -> str:
    def space():
        return chance.choice(SPACES) if chance.random() < 0.1 else chance.choice(SPACES[:2])

    members = [
        f'{space()}"{chance.choice(KEYS)}"{space()}:{space()}{chance.choice(VALUES)}'
        for _ in range(chance.randint(0, 6))
    ]
    text = "{" + ",".join(members) + space() + "}"
    if chance.random() < 0.05:
        text = text[: chance.randint(0, len(text))]
    if chance.random() < 0.3:
        text = chance.choice(AROUND) + text + chance.choice(AROUND)
    return text


def _refuse(constant):
    raise ValueError(constant)


def read(text: str):
    try:
        return json.loads(text, parse_constant=_refuse)
    except ValueError:
        return None


def whole(value):
    """int() of a value, or None."""
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return None


def expected(answer: str):
    text = answer.strip()
    first, last = text.find("{"), text.rfind("}")
    found = read(text if first == 0 else text[first : last + 1] if first >= 0 else "")
    found = found if isinstance(found, dict) else {}

    given = found.get("diagnosis")
    word = given.strip().lower() if isinstance(given, str) else None
    label = None
    if word in POSITIVE_WORDS or (word is None and whole(given) == 1):
        label = POSITIVE
    elif word in NEGATIVE_WORDS or (word is None and whole(given) is not None):
        label = NEGATIVE

    severity = whole(found.get("severity"))
    confidence = whole(found.get("confidence"))
    reason = found.get("reasoning") or found.get("explanation")
    return (
        label,
        severity if label == POSITIVE and severity in (1, 2, 3) else None,
        None if confidence is None else min(100, max(0, confidence)),
        reason if isinstance(reason, str) else None,
    )


def test_random_answers(spark):
    chance = random.Random(20)
    answers = [random_answer(chance) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(answers)), "id int, response string")
    got = {r.id: tuple(r)[1:] for r in normalize_predictions(df).collect()}
    wrong = [(a, got[i], expected(a)) for i, a in enumerate(answers) if got[i] != expected(a)]
    assert not wrong, (len(wrong), wrong[:5])


def test_random_lines(spark):
    chance = random.Random(21)
    keys = ["id", "label", "type", "sentence", "severity", "rationale"]

    def line():
        if chance.random() < 0.3:
            return random_answer(chance)
        members = [f'"{k}": {chance.choice(VALUES[:40])}' for k in keys if chance.random() < 0.9]
        return chance.choice(["", " ", "\t"]) + "{" + ", ".join(members) + "}" + chance.choice(["", " ", "x"])

    texts = [
        chance.choice(["\n", "\r\n", "\x0b", "\x85"]).join(line() for _ in range(8))
        for _ in range(400)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, response string")
    got: dict[int, list] = {}
    for row in explode_items(df).orderBy("n", "sentence_id").collect():
        got.setdefault(row.n, []).append((row.sentence_id, row.sentence))

    for n, text in enumerate(texts):
        objects = [read(part.strip()) for part in text.splitlines()]
        kept = [
            o for o in objects
            if isinstance(o, dict) and {"type", "sentence", "severity"} <= set(o)
        ]
        assert len(got.get(n, [])) == len(kept), text
        for (number, sentence), (i, item) in zip(got.get(n, []), enumerate(kept, 1)):
            assert number == i
            if isinstance(item["sentence"], str):
                assert sentence == item["sentence"]


def test_the_model_of_the_test_itself():
    assert expected('x {"diagnosis": 1, "severity": "2"} y') == (POSITIVE, 2, None, None)
    assert math.isinf(read('{"a": 1e400}')["a"])
