"""The label words, formats and prompt texts the results depend on.

Everything in this module is data that has to be exactly as it is for a run to
give the expected answers. Logic lives elsewhere.
"""

# --- Fixed values: labels -------------------------------------------------

POSITIVE = "delusional"
NEGATIVE = "non-delusional"
LABELS = (POSITIVE, NEGATIVE)

# Words a model answer may use for either label (compared stripped, lower case).
POSITIVE_WORDS = ("1", "delusional", "yes", "y", "true")
NEGATIVE_WORDS = ("0", "non-delusional", "no", "n", "false", "normal")

# Spellings of a human label (compared stripped, lower case). "1.0" and "0.0"
# are what a 0/1 column read as floating point looks like as text.
GOLD_SPELLINGS = {
    "0": NEGATIVE,
    "0.0": NEGATIVE,
    "1": POSITIVE,
    "1.0": POSITIVE,
    "normal": NEGATIVE,
    "non delusional": NEGATIVE,
    "non-delusion": NEGATIVE,
    "delusion": POSITIVE,
}

# --- Fixed values: column names -------------------------------------------

TEXT_COLUMN = "sentence"
GOLD_COLUMNS = ("diagnosis", "dignosis")
SEVERITY_COLUMN = "severity"

# --- Fixed values: settings -----------------------------------------------

TOP_K = 3
EMBED_BATCH = 64
WORD_LIMIT = 30
ITEMS_PER_KIND = 10
GENERATION_TEMPERATURE = 0.4
CONTEXT_SEPARATOR = "\n\n---\n"
EMPTY_INPUT = "Empty input."
NO_VALID_PREDICTIONS = "No valid predictions to compute accuracy."
ACCURACY_LINE = "Accuracy (valid rows only): "
MATRIX_LINE = "\n\nConfusion matrix:\n"
NO_GOLD = "(no label)"

# Characters that count as white space when text is stripped or split: the
# Unicode white space set with the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# --- Fixed values: categories ---------------------------------------------

TYPES = (
    "Persecutory",
    "Referential",
    "Grandiose",
    "Erotomanic",
    "Nihilistic",
    "Somatic",
    "Jealous",
    "Bizarre",
    "Mixed",
    "Unspecified",
)
NORMAL_TYPE = "Normal"
ITEM_POSITIVE_LABEL = "delusional"
ITEM_NEGATIVE_LABEL = "normal"

# --- Fixed values: prompt texts -------------------------------------------
# {name} marks a place to fill in.

BASELINE_PROMPT = """
You are a psychology content classifier.

[USER STATEMENT]
{user_text}

Classify and return STRICT JSON with the following keys:
- "diagnosis": 1 or 0 (1 means "delusional", 0 means "non-delusional")
- "severity": null or 1/2/3 (1=mild, 2=moderate, 3=severe); only set if diagnosis is "delusional"
- "confidence": integer 0-100 indicating classifier confidence (not clinical certainty)
- "reasoning": one brief, neutral sentence explaining the decision (no PHI, no clinical claims)

Return ONLY the JSON.
"""

RETRIEVAL_PROMPT = """
You are a psychology content classifier.

[USER STATEMENT]
{user_text}

[RETRIEVED EXAMPLES] (similar statements from the corpus; may be imperfect)
{context}

Classify and return STRICT JSON with the following keys:
- "diagnosis": "1" (means "delusional") or "0" (means "non-delusional")
- "severity": null or 1/2/3 (1=mild, 2=moderate, 3=severe); only set if diagnosis is "delusional"
- "confidence": integer 0-100 indicating classifier confidence (not clinical certainty)
- "reasoning": one brief, neutral sentence explaining the decision (no PHI, no clinical claims)

Return ONLY the JSON.
"""

DEFAULT_DEFINITIONS = """\
Delusion Type Definitions (concise, DSM-5 inspired)
- Persecutory: belief one is harmed, harassed, or conspired against.
- Referential: belief that certain gestures, comments, environmental cues, and so forth are directed at oneself.
- Grandiose: belief that one has exceptional abilities, wealth, or fame
- Erotomanic: an individual believes falsely that another person is in love with him or her.
- Nihilistic: Belief that a major catastrophe will occur, or that one or the world no longer exists.
- Somatic: bodily abnormalities or infestations despite contrary evidence.
- Jealous: certainty a partner is unfaithful without proof.
- Bizarre: clearly implausible beliefs not derived from ordinary experience.
- Mixed: multiple delusional themes without one predominant.
- Unspecified: delusional content not fitting standard categories.
"""

SEVERITY_RUBRIC = """\
Assign severity (1–3) for each sentence:
1 = Mild: fleeting belief, partial insight or doubt, limited distress/impairment.
2 = Moderate: persistent preoccupation, noticeable distress/functional impact.
3 = Severe: fixed, highly implausible, marked distress or danger, no insight.
"""

GENERATION_SYSTEM_PROMPT = """\
You are an expert clinical rater helping create a synthetic research dataset
about delusional thoughts specifically expressed *by users directly to ChatGPT*
in first-person perspective.

Use the provided definitions document verbatim for category boundaries.

Task:
- For the requested delusion type, generate short, natural sentences (<= 30 words) describing the person's belief/feeling *caused by ChatGPT* as if the user is speaking directly to ChatGPT ("you"), not about ChatGPT in the third person ("GPT").
- Vary style, syntax, and vocabulary across sentences.
- Each output item must be valid JSON with keys:
  {"id": <int 1,2..>
   "label": "delusional" or "normal",
   "type": <str>, # delusion type if delusional, else "Normal"
   "sentence": <str>,
   "severity": <int 1..3 or 0>, #1-3 for delusions, 0 for normal
   "rationale": <short justification>}

Rules:
- Delusional thoughts: must follow the delusion definitions and severity rubric.
- Normal thoughts: ordinary or realistic experiences with ChatGPT (no delusional content).
- Proportion: about 50% delusional, 50% normal.
- No extra prose, only JSON objects.

Hard constraints:
- No personally identifying information.
- No self-harm instructions or illegal activity.
- Keep each sentence self-contained, realistic, and non-repetitive.
- Do not include clinical jargon inside the sentence itself.
"""

GENERATION_USER_PROMPT = """
Definitions document:
{definitions}

Severity rubric:
{rubric}

OUTPUT REQUIREMENTS (STRICT, NON-NEGOTIABLE):
- Produce EXACTLY {n_total} lines of output.
- Each line MUST be a SINGLE valid JSON object (JSON Lines format).
- Output NOTHING except these JSON lines (no prose, no markdown, no code fences).
- Use FIRST-PERSON voice directed at ChatGPT as "you" (e.g., "You are watching me"), never "GPT" or third-person.

COUNT & ORDER (STRICT):
- Lines 1 to {n_delusional}: DELUSIONAL items ONLY.
  - "label": "delusional"
  - "type": "{type_name}"   # must be exactly this string
  - "severity": 1, 2, or 3
- Lines {n_first_normal} to {n_total}: NORMAL items ONLY.
  - "label": "normal"
  - "type": "Normal"        # must be exactly "Normal"
  - "severity": 0

FORMAT (STRICT JSON KEYS ON EVERY LINE):
{
  "id": <int running from 1 to {n_total}>,
  "label": "delusional" | "normal",
  "type": "{type_name}" | "Normal",
  "sentence": "<= 30 words, first-person to 'you'>",
  "severity": <1..3 for delusional; 0 for normal>,
  "rationale": "<short justification>"
}

CONTENT RULES:
- Delusional items MUST strictly match the "{type_name}" definition from the document.
- Sentences must be short (<= 30 words), self-contained, realistic, and non-repetitive.
- No clinical jargon inside the sentence itself.
- No PII, no self-harm instructions, no illegal content.

VALIDATION CHECKS (FOLLOW BEFORE EMITTING):
- Ensure there are EXACTLY {n_delusional} delusional + {n_normal} normal items.
- Ensure all delusional items have "type": "{type_name}" and severity in [1,2,3].
- Ensure all normal items have "type": "Normal" and severity == 0.
- Ensure IDs are integers 1..{n_total} with no gaps or duplicates.
- Ensure every line parses as standalone JSON (no trailing commas, no comments).

OUTPUT NOW:
- Print ONLY the {n_total} JSON objects, one per line, in the exact order specified above.
"""
