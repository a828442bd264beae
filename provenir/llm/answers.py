"""Problem 4: broken prompt and response pairs, by a multi-label linear classifier.

A record's features are hashed word n-grams of its prose (comments, sentences
and messages), the kind of ending that the stack automaton of the truncation
operator finds and whether that operator calls the text cut, and pair features:
how much work the answer does, which of its words the prompt doesn't have, which
natural and programming languages the two are in, and five yes-or-no rules made of
these. The training set is made from SAMPLE records: those that look whole are
the good ones, also with the prompt before them or with something cut behind
them, and from each, defective ones are made up by emptying, truncating, refusing,
copying the prompt and swapping the answer for one in another language. One
logistic regression a defect is fitted on two thirds of them; on the rest its
score is calibrated to a probability (two parameters, by maximum likelihood).
Scoring goes over all records whole. The score alone decides: a record has the
most probable defect if that is at least SURE, or none.

Records without candidate or with a null prompt are judged with an empty
prompt. Rows delivered twice count once.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import _phrases as P
from provenir.llm import truncation
from provenir.llm._text import slices
from provenir.runtime import cut, table

DEFECTS = ("empty", "refusal", "other_language", "echo", "truncated")
#: Records the classifier is fitted on, taken by the least hashes of their keys; buckets of the hashed n-grams.
SAMPLE, BUCKETS = 1500, 1024
#: Least calibrated probability of a defect.
SURE = 0.5
_DENSE = 27

_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_DOCSTRING = re.compile(r"\"{3}([\s\S]*?)(?:\"{3}|\Z)|'{3}([\s\S]*?)(?:'{3}|\Z)|/\*+([\s\S]*?)(?:\*/|\Z)")
_REMARK = re.compile(r"(?:#(?!include)|//)[ \t]*([^\r\n]*)")
_IDLE = re.compile(
    r"\s*(?:pass|\.\.\.|return(?:\s+None)?|[{}()\[\];\s]*|```[\w+-]*|<\|\w+\|>|</?s>|(?:async\s+)?def\b.*:|class\b.*:|@\w.*|#include.*|import\s+[\w., ]+|from\s+\S+\s+import\s.*|(?:(?:public|private|protected|final|static|abstract)\s+)*(?:class|interface|struct)\b[^;]*\{|"
    r"(?:(?:public|private|protected|final|static|inline|virtual|const)\s+)*[\w:<>&*\[\]]+\s+\w+\s*\([^;=]*\)\s*\{?|return\s*;|return\s+(?:null|nullptr)\s*;)\s*;?\s*",
    re.IGNORECASE,
)
_STUB = re.compile(r"\s*(?:raise\s+NotImplementedError|raise\s+\w*(?:Error|Exception)\s*\(\s*f?[\"']|throw\s+(?:new\s+)?[\w:]+\s*\(\s*\")[^\r\n]*")
_OWN = {lang: frozenset(words.split()) for lang, words in P.FUNCTION_WORDS.items()}


# What stands in sources of one language and hardly in those of others.
_CUES = {
    "python": ("self", "None", "def ", "elif ", "except ", " in ", ".append("),
    "java": ("final class", "public static", "public class", "throw new", "String ", "static int", "static void", "System.", "boolean ", "import java"),
    "cpp": ("#include", "std::", "auto ", "auto& ", "& ", "nullptr", "template <", "template<", "using namespace"),
}


def program_language(text: str) -> str:
    """python, java, cpp, braces where only braces tell, or nothing."""
    score = {lang: sum(map(text.count, cues)) for lang, cues in _CUES.items()}
    if truncation.braced(text):
        best = "java" if score["java"] > score["cpp"] else "cpp" if score["cpp"] > score["java"] else "braces"
        return best if not re.search(r"^[ \t]*def \w+\(", text, re.MULTILINE) else "python"
    if score["python"] and score["python"] >= max(score["java"], score["cpp"]) or re.search(r"^[ \t]*(?:\w+ = [^;{}]+[^;{}\s]|(?:def|for|if|while|with|class)\b[^;{}\n]*:|import \w+)[ \t]*\r?$", text, re.MULTILINE):
        return "python"
    return max(("java", "cpp"), key=lambda k: score[k]) if score["java"] != score["cpp"] else ""


def natural_language(words: list[str]) -> tuple[str, float]:
    """The language whose function words the words have most of, and their share; "" where they have none."""
    low = [w.lower() for w in words if w != "I"]
    if not low:
        return "", 0.0
    wide = sum(any(ord(c) > 0x2E7F for c in w) for w in low)
    if wide * 3 > len(low):
        return "zh", wide / len(low)
    if sum(any("Ѐ" <= c <= "ӿ" for c in w) for w in low) * 2 > len(low):
        return "ru", 1.0
    counts = {lang: sum(w in own for w in low) for lang, own in _OWN.items()}
    best = max(counts, key=lambda k: (counts[k], k == "en"))
    if counts[best] < 2 * counts["en"]:
        best = "en"
    return (best, counts[best] / len(low)) if counts[best] else ("", 0.0)


@functools.lru_cache(maxsize=4096)
def _prompt_facts(prompt: str) -> tuple[frozenset[str], str, str]:
    """The words of a prompt, the natural language of its prose and its programming language."""
    told = " ".join([x for m in _DOCSTRING.finditer(prompt) for x in m.groups() if x] + _REMARK.findall(prompt)) or prompt
    return frozenset(w.lower() for w in re.findall(r"\w+", prompt)), natural_language(_WORDS.findall(told))[0], program_language(prompt)


def answer_of(raw: str) -> str:
    """The answer alone, without the other files, prose and code that follow it."""
    head = raw.split("<file_sep>")[0]
    fences = list(truncation._FENCE.finditer(head))
    if fences:
        first = fences[0].start() <= len(head) - len(head.lstrip())
        begin = fences[0].end() if first else 0
        stop = fences[1].start() if first and len(fences) > 1 else len(head) if first else fences[0].start()
        head = head[begin:stop]
    return head.split("<|endoftext|>")[0]


def features(prompt: str, raw: str | None, clean: str | None, full: bool, unit: str, kind: str, is_open: bool, was_cut: bool | None = None) -> tuple[np.ndarray, dict]:
    """The feature vector of a record, and the facts its rules are made of; was_cut is the truncation operator's verdict."""
    was_cut = is_open or full if was_cut is None else was_cut
    raw, clean = raw or "", clean or ""
    answer = answer_of(raw)
    prose = truncation.is_prose(answer)
    notes = [x for m in _DOCSTRING.finditer(answer) for x in m.groups() if x]
    bare = _DOCSTRING.sub(" ", answer)
    remarks = [] if prose else _REMARK.findall(bare)
    bare = _REMARK.sub("", bare) if not prose else ""
    lines = [x for x in bare.splitlines() if x.strip()]
    stubs = [x for x in lines if _STUB.fullmatch(x)]
    acts = [x for x in lines if " = " in x or not _IDLE.fullmatch(x) and not _STUB.fullmatch(x)]
    all_words = [w.lower() for w in re.findall(r"\w+", answer)]
    known, asked, ours = _prompt_facts(prompt)
    fresh = [w for w in all_words if w not in known]
    theirs = program_language(answer) if acts else ""
    braces = {"java", "cpp", "braces"}
    swapped = bool(theirs and ours) and (ours != theirs and not (theirs == "braces" and ours in braces) and not (ours == "braces" and theirs in braces))
    words: list[str] = []
    spoken, share = "", 0.0
    if not acts:  # what is told beside working code says nothing of a defect
        told = " ".join([answer] if prose else [*notes, *remarks, *stubs])
        words = _WORDS.findall(re.sub(r"`[^`]*`|\b\w*_\w*\b|\b[a-z]+[A-Z]\w*\b", " ", told))
        spoken, share = natural_language(words)
    foreign = bool(spoken) and spoken != (asked or "en") and len(words) >= 4 and share >= 0.15
    first_person = sum(w.lower() in ("i", "i'm", "i'd", "i've", "i’m", "my", "me", "we") for w in words)
    facts = {"acts": len(acts), "fresh": len(fresh), "words": len(all_words), "swapped": swapped, "foreign": foreign, "stubs": len(stubs), "told": len(words), "spoken": spoken, "cut": was_cut and unit == "answer"}
    vector = np.zeros(_DENSE + BUCKETS, np.float32)
    vector[:_DENSE] = [
        *(holds(d, facts) for d in DEFECTS),
        1.0, not acts, min(len(acts), 10) / 10, not answer.strip(), not all_words, bool(all_words) and not fresh, len(fresh) / max(1, len(all_words)), bool(stubs) and not acts, prose, swapped, foreign,
        share if foreign else 0.0, spoken in ("", "en"), bool(first_person), first_person / max(1, len(words)), is_open, full, unit == "answer", is_open and unit == "answer", full and unit == "answer", not clean.strip(), bool(remarks) and not acts and not notes,
    ]
    low = [w.lower() for w in words]
    grams = [f"{unit}|{kind}"] + ([] if acts else [*low, *(f"{a} {b}" for a, b in zip(low, low[1:]))])
    for g in grams:
        vector[_DENSE + zlib.crc32(g.encode()) % BUCKETS] += 1
    tail = vector[_DENSE:]
    norm = float(np.sqrt((tail**2).sum()))
    if norm:
        tail /= norm
    return vector, facts


def holds(defect: str, facts: dict) -> bool:
    """The rule of a defect, one feature among the others."""
    if defect == "empty":
        return not facts["acts"] and not facts["foreign"]
    if defect == "refusal":
        return not facts["acts"] and facts["told"] >= 4 and facts["spoken"] in ("", "en")
    if defect == "other_language":
        return facts["swapped"] if facts["acts"] else facts["foreign"]
    if defect == "echo":
        return not facts["acts"] and facts["words"] > 0 and not facts["fresh"]
    return facts["cut"]


def make_up(prompt: str, answer: str, others: list[tuple[str, str]], rng: random.Random) -> list[tuple[str, str, bool]]:
    """Defective answers (defect, text, fills its field) made from a good one."""
    indent = " " * rng.choice((0, 4, 8))
    name = (re.findall(r"(\w+)\s*\(", prompt) or ["it"])[0]
    mark = rng.choice(("#", "//"))
    out = []
    idle = rng.choice(["", "\n", "   \n\t\n", f"{indent}pass\n", f"{indent}...\n", f"{indent}{mark} TODO\n{indent}pass\n", "```\n```\n", f"{indent}return None\n", "<|endoftext|>", f"{indent}{mark} {rng.choice(['fill in later', 'to be done', 'Sort the entries before the merge', 'Walk over the rows'])}.\n"])
    out.append(("empty", idle, False))
    spot = rng.randrange(len(answer) // 10, max(len(answer) // 10 + 1, len(answer) - 2)) if len(answer) > 40 else 0
    if spot:
        piece = answer[:spot].rstrip("\n") + rng.choice(["", "", "", "", "…", "�", "...", "\n"])
        out.append(("truncated", piece, rng.random() < 0.6))
    refusal = rng.choice(P.REFUSAL_OPENERS) + rng.choice(P.REFUSAL_CORES).format(x=rng.choice(P.REFUSAL_OBJECTS).format(f=name)) + rng.choice(P.REFUSAL_REASONS) + "." + rng.choice(P.REFUSAL_CLOSERS)
    dress = rng.choice(["{r}", "\n\n{r}\n", "{i}{m} {r}\n{i}pass\n", '{i}raise NotImplementedError("{r}")\n', '{i}"""{r}"""\n', "{i}{m} {r}\n"])
    out.append(("refusal", dress.format(r=refusal, i=indent, m=mark), False))
    said = [x.strip() for m in _DOCSTRING.finditer(prompt) for x in m.groups() if x] or _REMARK.findall(prompt) or [prompt]
    copy = rng.choice([prompt, prompt + "\n" + prompt, prompt.upper(), said[0], f'{indent}"""{said[0]}"""\n', f"{indent}{mark} {said[0]}\n", re.sub(r"(?m)^ +", "  ", prompt), prompt.strip()])
    out.append(("echo", copy, False))
    if others and rng.random() < 0.5:
        out.append(("other_language", rng.choice(others)[1], False))
    else:
        lang = rng.choice(sorted(P.FOREIGN_SENTENCES))
        told = [rng.choice(P.FOREIGN_SENTENCES[lang]) for _ in range(rng.randrange(2, 6))]
        out.append(("other_language", " ".join(told) + rng.choice(["", "\n"]) if rng.random() < 0.5 else "".join(f"{indent}{mark} {t}\n" for t in told), False))
    return out


def whole_variants(prompt: str, answer: str, other: str, rng: random.Random) -> list[str]:
    """Answers that are no defect: behind the prompt repeated, and before another text that is cut."""
    out = [prompt.rstrip("\n") + "\n" + answer]
    for _ in range(2):
        piece = other[: rng.randrange(2, max(3, len(other)))].rstrip("\n") + rng.choice(["", "", "", "…", "..."])
        between = rng.choice(["\n```\nThis function walks over the ", "\n<file_sep>\n", "\n\ndef other_one(value):\n", "\n\n\nclass Other:\n    def run(self):\n", "\n\nif __name__ == '__main__':\n", "\n\n# Example:\n#   the next "])
        out.append(answer.rstrip() + between + piece)
    return out


def _calibrated(logit: np.ndarray, real: np.ndarray, steps: int = 40) -> tuple[float, float]:
    """Slope and shift that make the logits of held-out rows the likeliest probabilities of real, by Newton steps."""
    slope, shift = 1.0, 0.0
    x = np.stack([np.clip(logit, -30, 30), np.ones(len(logit))])
    for _ in range(steps):
        p = _sigmoid(slope * x[0] + shift)
        g = x @ (p - real) + 1e-2 * np.array([slope - 1, shift])
        h = (x * np.maximum(p * (1 - p), 1e-6)) @ x.T + 1e-2 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = max(0.05, slope - float(step[0])), shift - float(step[1])
    return slope, shift


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[str, str]], seed: int = 11, steps: int = 160) -> tuple[np.ndarray, np.ndarray, dict[str, tuple[float, float]]]:
    """Weights (features x defects), calibration (defects x slope and shift), and held-out precision and recall of each defect, from (prompt, raw output) rows."""
    rng = random.Random(seed)
    vectors: list[np.ndarray] = []
    labels: list[int] = []
    usual: dict[tuple, int] = {}  # endings of the good ones

    def add(prompt: str, raw: str, full: bool, label: int, checked: bool = False) -> bool:
        unit, kind, is_open = truncation.ending(raw, prompt)
        if checked:
            usual[unit, kind] = usual.get((unit, kind), 0) + 1
        was_cut = is_open or full or not checked and usual.get((unit, kind), 0) * 200 < len(usual) and bool(raw.strip())
        vector, facts = features(prompt, raw, raw, full, unit, kind, is_open, was_cut)
        if checked and (not facts["acts"] or facts["swapped"] or is_open):
            return False
        if label >= 0 and DEFECTS[label] == "truncated" and unit == "after" or label < 0 and not checked and is_open and unit == "answer":
            return False  # the place of the cut can't be told
        vectors.append(vector)
        labels.append(label)
        return True

    good = [(p, r) for p, r in rows if r and len(r) > 40 and add(p, r, False, -1, True)]
    by_language: dict[str, list[tuple[str, str]]] = {}
    for p, r in good:
        by_language.setdefault(program_language(p), []).append((p, r))
    for p, r in good:
        mine = program_language(p)
        others = [x for k, v in by_language.items() if k and k != mine and {k, mine} != {"braces", "java"} and {k, mine} != {"braces", "cpp"} for x in v[:20]]
        answer = answer_of(r).rstrip() + "\n"
        same = by_language[mine]
        for text, full in zip(whole_variants(p, answer, answer_of(rng.choice(same)[1]), rng), (False, rng.random() < 0.6, rng.random() < 0.6)):
            add(p, text, full, -1)
        for defect, text, full in make_up(p, answer, others, rng):
            add(p, text, full, DEFECTS.index(defect))
    if not vectors:
        return np.zeros((_DENSE + BUCKETS, len(DEFECTS)), np.float32), np.tile([1.0, -30.0], (len(DEFECTS), 1)), {}
    x, y = np.stack(vectors), np.array(labels)
    held = np.random.default_rng(seed).random(len(y)) < 1 / 3
    target = (y[:, None] == np.arange(len(DEFECTS))[None, :]).astype(np.float32)
    xt, tt = x[~held], target[~held]
    weights, m, v = (np.zeros((x.shape[1], len(DEFECTS)), np.float32) for _ in range(3))
    for step in range(1, steps + 1):  # Adam on the regularised log loss
        slope = xt.T @ (_sigmoid(xt @ weights).astype(np.float32) - tt) / len(xt) + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    logits = x[held] @ weights
    scale = np.array([_calibrated(logits[:, d].astype(float), target[held][:, d].astype(float)) for d in range(len(DEFECTS))])
    said, quality = decided(logits, scale)[0], {}
    for d, name in enumerate(DEFECTS):
        real, hit = y[held] == d, float(((said == d) & (y[held] == d)).sum())
        quality[name] = (hit / max(1.0, float((said == d).sum())), hit / max(1.0, float(real.sum())))
    return weights, scale, quality


def decided(logits: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's defect (-1 for none), and the calibrated probabilities of all defects."""
    chance = _sigmoid(logits * scale[:, 0] + scale[:, 1])
    best = chance.argmax(axis=1)
    return np.where(chance.max(axis=1) >= SURE, best, -1), chance


def judged(checkpoints: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every output with its defect (null for none) and the calibrated probabilities of all defects.

    checkpoints has what truncation.cut_outputs needs; candidates has line_no and prompt.
    """
    endings = truncation.cut_outputs(checkpoints).select("line_no", "tag", "unit", "class", "open", "full", "cut")
    prompts = candidates.where("line_no is not null").groupBy("line_no").agg(F.first("prompt", ignorenulls=True).alias("prompt"))
    outputs = checkpoints.where("line_no is not null and tag is not null").select("line_no", "tag", "raw_output", "clean_output").dropDuplicates(["line_no", "tag"])
    pairs = outputs.join(endings, ["line_no", "tag"]).join(prompts, "line_no", "left")
    some = outputs.where("raw_output is not null").orderBy(F.xxhash64("line_no", "tag"), "line_no", "tag").limit(SAMPLE)
    sample = some.join(prompts, "line_no", "left").select(F.coalesce("prompt", F.lit("")).alias("prompt"), "raw_output", "line_no", "tag").collect()
    weights, scale, _ = fit([(r["prompt"], r["raw_output"]) for r in sorted(sample, key=lambda r: (r["line_no"], r["tag"]))])
    model = checkpoints.sparkSession.sparkContext.broadcast((weights, scale))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, scale = model.value
        for batch in slices(batches, "raw_output"):
            columns = (batch.column(c).to_pylist() for c in ("prompt", "raw_output", "clean_output", "full", "unit", "class", "open", "cut"))
            made = [features(p or "", raw, clean, full, unit, kind, is_open, was_cut)[0] for p, raw, clean, full, unit, kind, is_open, was_cut in zip(*columns)]
            if not made:
                continue
            found, scores = decided(np.stack(made) @ w, scale)
            defects = [DEFECTS[d] if d >= 0 else None for d in found.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("line_no"), batch.column("tag"), pa.array(defects, pa.string()), *(pa.array(scores[:, i].astype(np.float64)) for i in range(len(DEFECTS)))],
                ["line_no", "tag", "defect", *(f"{d}_score" for d in DEFECTS)],
            )

    return pairs.mapInArrow(work, "line_no int, tag string, defect string, " + ", ".join(f"{d}_score double" for d in DEFECTS))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(truncation._checkpoints(spark, sf_dir), table(spark, sf_dir, "candidates").select("line_no", "prompt"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("defect is not null").select("line_no", "tag", "defect")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per experiment and defect: records and their share of the experiment."""
    found = cut(_judged(spark, sf_dir).select("line_no", "tag", "defect"), "p4-judged")
    source = table(spark, sf_dir, "checkpoints").groupBy("line_no", "tag").agg(F.min("experiment").alias("experiment"))
    rows = found.join(source, ["line_no", "tag"])
    size = rows.groupBy("experiment").agg(F.count("*").alias("outputs"))
    return rows.where("defect is not null").groupBy("experiment", "defect").agg(F.count("*").alias("records")).join(size, "experiment").withColumn("share", F.col("records") / F.col("outputs"))
