"""Inputs derived from the driver's tables, as SQL both engines read the same way.

Model answers are rendered from ``labels`` by fixed rules, since no model is at
hand. They exercise the mechanics; the accuracy they give means nothing.
"""

from __future__ import annotations

# --- Classification answers: eight shapes, good and bad --------------------


def answer_sql(shift: int) -> str:
    """One answer per labelled document; ``shift`` moves the shapes along."""
    return f"""case (doc_id + {shift}) % 8
  when 0 then concat('{{"diagnosis": ', toxic, ', "severity": ', 1 + doc_id % 4, ', "confidence": ', doc_id % 130, ', "reasoning": "r', doc_id, '"}}')
  when 1 then concat('{{"diagnosis": "', toxic, '", "severity": "', 1 + doc_id % 3, '", "confidence": "90", "reasoning": "", "explanation": "e"}}')
  when 2 then concat('{{"diagnosis": "', case when toxic = 1 then ' Delusional' else 'NORMAL ' end, '", "severity": 2.7, "confidence": 88.9}}')
  when 3 then concat('Sure: {{"diagnosis": ', 1 - toxic, ', "severity": null, "confidence": -5}} done')
  when 4 then concat('{{"diagnosis": ', case when toxic = 1 then 'true' else 'false' end, ', "severity": "2.0", "confidence": "high"}}')
  when 5 then '{{"diagnosis": "maybe", "severity": 1, "confidence": 50, "reasoning": 7}}'
  when 6 then concat('{{"diagnosis": ', toxic, ', "severity": 1}} trailing text')
  else 'I cannot help.' end"""


# The second run's shift: by one, so that some documents have a severity in both runs.
SECOND_RUN = 1

# Human severity: only where the human label is positive.
GOLD_SEVERITY_SQL = "case when toxic = 1 then 1 + doc_id % 3 end"

# The human label in the spellings it comes in.
GOLD_TEXT_SQL = """case doc_id % 5
  when 0 then cast(toxic as string)
  when 1 then case when toxic = 1 then 'Delusion' else 'Normal ' end
  when 2 then case when toxic = 1 then 'delusional' else ' non delusional' end
  when 3 then case when toxic = 1 then '1.0' else '0.0' end
  else case when quality = 1 then 'Unsure' end end"""

# A sentence that is missing for unlabelled and blank for low-quality documents.
PATCHY_TEXT_SQL = "case when quality is null then null when quality = 0 then '  ' else text end"

# --- Generation answers: JSON lines with every kind of flaw ----------------

ITEMS_SQL = """concat(
  '```json', chr(10),
  '{"id": 1, "label": "delusional", "type": "T', doc_id % 10, '", "sentence": "', repeat('word ', cast(doc_id % 40 as int)), 'a', doc_id, '", "severity": ', 1 + toxic, ', "rationale": "because"}', chr(10),
  chr(10),
  '  {"id": 2, "label": "normal", "type": "Normal", "sentence": "n', doc_id % 17, '", "severity": 0, "rationale": null}  ', chr(10),
  '{"id": 3, "label": "normal", "type": "Normal", "severity": 0}', chr(10),
  case when doc_id % 3 = 0 then '' else '{"id": 4, "label": "normal", "type": null, "sentence": "s", "severity": 9}' end, chr(10),
  '42', chr(10), 'null', chr(10), '["type", "sentence", "severity"]', chr(10),
  '{"id": 5, "label": "normal", "type": "Normal", "sentence": "cut', chr(10),
  '```')"""

ITEM_TYPE_SQL = "concat('T', doc_id % 10)"

# --- Stand-in models -------------------------------------------------------

MODEL = "stand-in"


def stand_in_answers(prompts: list[str]) -> list[str]:
    """An answer that depends on the length of the prompt alone."""
    answers = []
    for prompt in prompts:
        n = len(prompt)
        answers.append(
            f'{{"diagnosis": "{n % 2}", "severity": {1 + n % 3}, '
            f'"confidence": {n % 130}, "reasoning": "length {n}"}}'
        )
    return answers


COUNTED = ("a", "e", "i", "o", "u", "n", " ", "\n")


def stand_in_vectors(texts: list[str]) -> list[list[float]]:
    """How often each of a few characters occurs."""
    return [[float(text.count(c)) for c in COUNTED] for text in texts]
