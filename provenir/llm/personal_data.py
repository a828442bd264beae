"""Problem 10: personal information in free text, by boosted trees over candidate spans.

Generators with high recall propose overlapping spans of five types in the
whole text. For each type gradient-boosted trees, fitted on TRAINING made-up
documents, score a span by its format and its context; the threshold of a type
is the one with the best F1 on held-out made-up documents. Of overlapping
spans the best scored wins, the longer one on a tie. The text is given again
with a placeholder of its type in each span's stead.

Null ids and null texts are no documents; an empty text has no span. Rows
delivered twice count once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import _boosting, _pii_samples
from provenir.llm._phrases import FUNCTION_WORDS
from provenir.llm._text import slices
from provenir.runtime import cut, spread, table

TYPES = ("email", "phone", "id_number", "address", "name")
#: Made-up documents the trees are fitted on; a third is held out for the thresholds.
TRAINING = 3000

_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩА-Я"
_T = rf"[{_UPPER}][^\W\d_{_UPPER}]+(?:[-'’][{_UPPER}]?[^\W\d_]+)*|[{_UPPER}]['’][{_UPPER}][^\W\d_]+(?:-[{_UPPER}][^\W\d_]+)*"
_TOWN = rf"(?:(?:St\.|San|Santa|Bad|New|North|South|East|West|Le|La|Les|Los|El) )?[{_UPPER}][^\W\d_]+(?:[-'’][{_UPPER}]?[^\W\d_]+)*"
_POST = r"(?:\d{4,5}|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})"
# Words for streets.
_EN_KIND = r"(?:Street|St|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Avenue|Ave|Close|Terrace|Mews|Way|Blvd|Boulevard|Place|Pl|Square|Sq|Crescent|Gardens|Grove|Hill|Park|Row|Walk|Highway|Parkway)\.?"
_DE_KIND = r"(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|hof|steig|markt)"
_FR_KIND = r"(?:rue|avenue|allée|boulevard|bd|place|chemin|quai|impasse|route|cours|square|passage)"
_ES_KIND = r"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrer|Ronda|Travesía|Via|Viale|Piazza|Rua|Praça)"
_ANY = rf"[^\W\d_]+(?:['’\-][^\W\d_]+)*"

GENERATORS = {
    "email": [
        re.compile(r"(?<![\w.+%'-])[\w.+%'-]++@[\w-]+(?:\.[\w-]+)+"),
        re.compile(r"(?<![\w.+%'-])[\w.+%'-]++\s?[\[({]\s?at\s?[\])}]\s?[\w-]+(?:\s?[\[({]\s?dot\s?[\])}]\s?[\w-]+)+", re.IGNORECASE),
        re.compile(r"(?<![\w.+%'-])[\w.+%'-]++ (?:AT|at) [\w-]+(?: (?:DOT|dot) [\w-]+)+"),
        re.compile(r"(?<![\w.+%'-])[\w.+%'-]++@[\w-]+(?:\s?(?:[\[({]dot[\])}]|\bdot\b)\s?[\w-]+)+", re.IGNORECASE),
        re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]+"),
    ],
    "phone": [
        re.compile(r"\+\d{1,3}(?:[ .\-/]?\(\d{1,4}\))?(?:[ .\-/]?\d{1,8}){1,6}(?!\w)"),
        re.compile(r"\(\+?\d{2,5}\)[ .\-/]?\d{2,8}(?:[ .\-/]\d{2,6}){0,4}(?!\w)"),
        re.compile(r"\d(?<![\w.,+\-(/]\d)\d{1,4}(?:[ .\-/]\d{2,8}){1,5}(?!\w)(?!\.\d)"),
        re.compile(r"0(?<![\w.,+\-(/]0)\d{8,12}(?!\w)"),
    ],
    "id_number": [
        re.compile(r"\d(?<![\w\-.]\d)\d{2}([- ])\d{2}\1\d{4}(?![\w\-])"),
        re.compile(r"[A-Z](?<![\w\-][A-Z])[A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?!\w)"),
        re.compile(r"\d(?<![\w\-]\d)\d{6,7}-?[A-Z](?!\w)"),
        re.compile(r"\d(?<![\w\-.]\d)\d{5,7}[-+]\d{4}(?![\w\-])"),
        re.compile(r"\d(?<![\w\-.]\d)\d(?: \d{3}){3}(?![\w\-])"),
        re.compile(r"[A-Z](?<![\w\-][A-Z])[A-Z]{0,2}\d{6,9}(?!\w)"),
        re.compile(r"[A-Z](?<![\w\-][A-Z])[A-Z]{0,2}\d{0,4}(?:-\d{2,6}){1,4}(?![\w\-])"),
        re.compile(r"\d(?<![\w\-.]\d)\d{8,12}(?!\w)"),
    ],
    "address": [
        re.compile(rf"(?:(?:Flat|Apt|Apartment|Unit|Suite)\.? \d+\w?,\s{{1,2}})?\d{{1,5}}[a-zA-Z]? (?:[{_UPPER}][\w'’-]*\.? ){{1,3}}{_EN_KIND}(?:,? (?:Apt|Apartment|Flat|Unit|Suite|#)\.? ?\d+\w?)?,\s{{1,2}}{_TOWN}(?:,? {_POST})?"),
        re.compile(rf"(?:[{_UPPER}][^\W\d_]*{_DE_KIND}|[{_UPPER}]\w+ (?:Straße|Str\.|Weg|Allee|Gasse|Platz|Ring)) \d{{1,4}} ?[a-z]?,\s{{1,2}}\d{{4,5}} {_TOWN}"),
        re.compile(rf"\d{{1,4}}(?: ?(?:bis|ter))?,? {_FR_KIND} {_ANY}(?:[ ]{_ANY}){{0,5}},\s{{1,2}}\d{{4,5}} {_TOWN}", re.UNICODE),
        re.compile(rf"{_ES_KIND} {_ANY}(?: {_ANY}){{0,5}},? \d{{1,4}}\w?,\s{{1,2}}\d{{4,5}} {_TOWN}"),
    ],
    # tried at every capital that no other sign forbids (STARTS), so names may overlap
    "name": [
        re.compile(rf"(?:{_T})(?: [{_UPPER}]\.)*(?: (?:van|von|de|da|del|di|la|le|der|den|dos|al|bin|ter))* (?:{_T})(?![\w@`(/])"),
        re.compile(rf"(?:[{_UPPER}]\. ?)+(?:{_T})(?![\w@`(/])"),
        re.compile(rf"(?:{_T}), (?:{_T}|[{_UPPER}]\.)(?![\w@`(/])"),
    ],
}
#: Places where the generators of a type are tried, by a sign the engine can seek; other generators look for themselves.
STARTS = {"name": re.compile(rf"[{_UPPER}](?<![\w@.\-/`'’].)"), "id_number": re.compile(r"\d(?<![\w\-].)(?=\d)|[A-Z](?<![\w\-].)(?=[A-Z]{0,2} ?[\d-])")}
#: What a text must hold for the first generator of addresses to match.
_HOUSE = re.compile(rf"\d[a-zA-Z]? [{_UPPER}]")

# Words that go before personal information, and words that go before what only looks like it.
_TRIGGERS = {
    "name": "by author maintainer reviewer annotator contact from with to name is am thanks thank cc signed authored reviewed reported tested acked spoke talked met asked ask von par por signalé gemeldet reportado saludos grüße cordialement regards wishes cheers dr prof mr mrs ms herr frau according patient labelled written assigned before".split(),
    "phone": "tel phone call mobile cell fax t ring on is number hotline whatsapp telefon tél tlf reach handy teléfono at".split(),
    "id_number": "ssn security nino ni insurance dni id passport licence license steuer-id no number nr says has card pesel cpr personal nie".split(),
    "address": "office address is to at lives in disk adresse anschrift dirección".split(),
    "email": "contact at to mail mailto email address is me cc logs an à a write author".split(),
}
_AGAINST = "version release ticket seed run scores line build commit module pinned port pid sha sha256 node rows between from part order code error model timestamp project library clone install ssh file figure table chapter issue lines about grid of".split()
_STARTERS = frozenset(
    "the this that these those a an we i it you he she they my our your no not now once after before when while if could would should please see use using used running reverting threshold tokens seeds docs nobody one two some all both each for from with without in on at by to as and or but so then there here is are was were be do does did can may must will what who how why "
    "send call ship office contact postal module run ran pinned ticket traceback file value scores seed score commit release build steps expected actual open good kind best many thanks thank regards wishes running reported signed reviewed tested merged ask let make add fix remove move rename update check given return raise print two assume report only for example write".split()
) | frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
_STARTERS |= frozenset("viele grüße saludos cordialement liebe kann wir im bei nach seit con tras conviene quelqu'un quelqu alguien escríbeme bitte merci le la les el die der das ein eine".split())
_NOT_NAMES = frozenset("team bot release static analysis integration continuous software license version forest open source library module core data lake foundation everyone behaviour result reproduce below report street road avenue city university institute street department".split())

_WITH_SIGN = [g for g in GENERATORS["email"] if "@" in g.pattern]
_SPELLED = (" at ", "[at", "(at", "{at", "[ at", "( at", "{ at")

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_NUMBER = re.compile(r"\d+")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, number of the type) of all spans that may hold personal information."""
    found = set()
    low = text.lower()
    spelled = "dot" in low and any(s in low for s in _SPELLED)
    for t, kind in enumerate(TYPES):
        if kind in STARTS:
            for at in STARTS[kind].finditer(text):
                for g in GENERATORS[kind]:
                    if m := g.match(text, at.start()):
                        found.add((*m.span(), t))
            continue
        for g in GENERATORS[kind]:
            if g is GENERATORS["address"][0] and not _HOUSE.search(text):
                continue
            if kind == "email" and not ("@" in text if g in _WITH_SIGN else spelled):
                continue  # the generator can't match
            for m in g.finditer(text):
                b, e = m.span()
                while kind == "email" and e > b and text[e - 1] in ".-'_":
                    e -= 1
                while kind == "email" and b < e and text[b] in ".-'%+":
                    b += 1
                digits = sum(c.isdigit() for c in text[b:e])
                if kind == "phone" and not 7 <= digits <= 15:
                    continue
                found.add((b, e, t))
    return sorted(found)


def features(text: str, b: int, e: int, t: int) -> list[float]:
    """The format and context of a span as numbers."""
    kind, span = TYPES[t], text[b:e]
    line = text.rfind("\n", 0, b) + 1
    stop = text.find("\n", e)
    stop = len(text) if stop < 0 else stop
    before, after = text[max(line, b - 40) : b], text[e : min(stop, e + 24)]
    words = [w.lower() for w in _WORD.findall(before)]
    near = words[-2:]
    last = near[-1] if near else ""
    tight = before.rstrip()[-1:] if before.strip() else ""
    follow = _WORD.findall(after)
    nxt = follow[0].lower() if follow else ""
    triggers = _TRIGGERS[kind]
    groups = [len(x) for x in _NUMBER.findall(span)]
    digits = sum(groups)
    capitals = sum(c.isupper() for c in span)
    shared = [
        float(last in triggers), float(any(w in triggers for w in near)), float(any(w in triggers for w in words[-4:])), float(last in _AGAINST), float(any(w in _AGAINST for w in words[-3:])), float(b == line or not text[line:b].strip()), float(e >= stop or not text[e:stop].strip()),
        float(tight == ":"), float(tight in "<(\"["[:4] and tight != ""), float(before[-1:].isspace() or not before), float(after[:1] in ".,;:)>\"\r" or not after), len(span), digits, capitals, float(tight in ".!?"), float(text[max(0, line - 4) : line].strip() == "--"),
    ]
    if kind in ("phone", "id_number"):
        shared += [
            len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, max(groups, default=0), min(groups, default=0), float(span[:1] == "+"), float(span[:1] == "("), float(span[:2] == "00"), float(re.search(r"(?:^|\D)555\D", span) is not None), float(span[:1] == "0"), float("-" in span), float(" " in span), float("." in span), float(span[-1:].isalpha()), float(span[:1].isalpha()), float(span[:2].isalpha()), float(span[:3].isalpha()),
            float(re.fullmatch(r"\d{1,2}-\d{1,2}-(?:19|20)\d{2}|(?:19|20)\d{2}-\d{1,2}-\d{1,2}", span) is not None), float(re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", span) is not None), float(re.match(r"(?:19|20)\d{6}-", span) is not None), float(re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", span) is not None), float(re.fullmatch(r"\d{3}-\d{4}", span) is not None),
            float(re.fullmatch(r"[A-Z]{2} ?(?:\d{2} ?){3}[A-Z]", span) is not None), float(re.fullmatch(r"\d{2}(?: \d{3}){3}", span) is not None), float(re.fullmatch(r"\d{6}-\d{4}", span) is not None), float(re.fullmatch(r"\d{8}[A-Z]", span) is not None), float(re.fullmatch(r"[A-Z]\d{3}-\d{4}-\d{4}", span) is not None), float(re.fullmatch(r"[A-Z]{1,2}\d{7,8}", span) is not None),
            float(before[-1:] in ".-/_" and before != ""), float(after[:1] in "-/%_" and after != ""), float(nxt in ("rows", "lines", "minutes", "files", "percent", "tokens", "and")), float(re.fullmatch(r"0\.\d+-0\.\d+", span) is not None), float(re.search(r"\d\.\d{1,4}$", before) is not None),
        ]
    elif kind == "email":
        local, _, host = span.partition("@")
        shared += [
            float("@" in span), float("." in host), float(re.search(r"\d+\.\d+", host) is not None and not re.search(r"[a-z]{2,}$", host, re.IGNORECASE)), float(local in ("git", "user", "deploy", "root", "ssh", "your-email")), float(after[:1] == ":"), float(after[:1] == "/"), float(host.isupper() and "." not in host), float("[" in span or "(" in span), float(" AT " in span), float(" at " in span),
            float(" dot " in span.lower() or "dot]" in span.lower() or "dot)" in span.lower()), float(local.endswith("-lib")), float(host[:1].isdigit()), float(re.search(r"\.[a-z]{2,}$", span, re.IGNORECASE) is not None), float("." in local), len(local), float(re.search(r"\b(?:clone|ssh|scp|install|pinned|pip|npm)\b", before.lower()) is not None), float("domain.tld" in span), float(local == ""),
        ]
    elif kind == "address":
        shared += [float(span[:1].isdigit()), float(span.startswith(("Flat", "Apt", "Unit"))), float(re.search(rf"{_POST}$", span) is not None), float(re.search(r"\d{5} \S+$", span) is not None), span.count(","), float(re.match(rf"(?:,? {_POST})(?!\w)", after) is not None), float(last in _STARTERS)]
    else:
        tokens = [x for x in re.findall(rf"(?:{_T})|[{_UPPER}]\.", span)]
        low = [x.lower() for x in tokens]
        prior = re.search(rf"({_T}|[{_UPPER}]\.) $", before)
        prior_word = prior.group(1).lower() if prior else ""
        later = re.match(rf" ({_T})", after)
        shared += [
            float(last in ("the", "a", "an", "our", "der", "die", "das", "le", "la", "les", "el", "los", "un", "une", "ein", "eine")), len(tokens), float(any(x in _STARTERS for x in low)), float(bool(low) and low[0] in _STARTERS), float(bool(low) and low[-1] in _STARTERS), float(any(x in _NOT_NAMES for x in low)), float(prior is not None and prior_word not in _STARTERS), float(later is not None), float(later is not None and later.group(1).lower() in _STARTERS), float("," in span), float(any(x.endswith(".") for x in tokens)), float(bool(tokens) and tokens[0].endswith(".")),
            float(after.lstrip()[:1] in "<(" and after.strip() != ""), float(nxt in ("asked", "and", "wrote", "about", "for", "who", "the", "has", "said", "reported", "called", "yesterday", "in", "hat", "signed")), float(re.search(r"(?:-by|[Aa]uthor|[Mm]aintainer|[Aa]nnotator|[Cc]ontact|by|[Rr]eviewer):\s*$", before) is not None), float(re.search(r"\b(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau)\.? $", before) is not None),
            min(map(len, tokens), default=0), max(map(len, tokens), default=0), float(re.search(r"(?:Grüße|Saludos|Cordialement|Regards|wishes|Cheers|Thanks),\s*$", before) is not None), float(bool(low) and low[0] in ("viele", "saludos", "cordialement", "regards", "best")), float("-" in span), float(before[-1:] == " "), float(re.search(rf"(?:{_T}), $", before) is not None), float(re.match(rf", (?:{_T})", after) is not None),
        ]
    return shared


@functools.lru_cache(maxsize=2)
def fit(seed: int = 5) -> dict[str, tuple[_boosting.Trees, float, float, float]]:
    """Trees, threshold, and held-out precision and recall of each type; fitted once in a process and kept."""
    rows: dict[int, list] = {t: [] for t in range(len(TYPES))}
    for number, (text, marks) in enumerate(_pii_samples.documents(TRAINING, seed)):
        real = {(b, e, k) for b, e, k in marks}
        for b, e, t in candidates(text):
            rows[t].append((features(text, b, e, t), (b, e, TYPES[t]) in real, number % 3 == 0))
    out = {}
    for t, kind in enumerate(TYPES):
        x = np.array([r[0] for r in rows[t]], np.float64)
        y, held = np.array([r[1] for r in rows[t]], float), np.array([r[2] for r in rows[t]])
        trees = _boosting.fit(x[~held], y[~held])
        score, real = _boosting.predict(trees, x[held]), y[held] > 0.5
        best = (-1.0, 0.5, 0.0, 0.0)
        for limit in np.linspace(0.1, 0.9, 33):
            said = score >= limit
            p, r = (said & real).sum() / max(1, said.sum()), (said & real).sum() / max(1, real.sum())
            f1 = 2 * p * r / max(1e-9, p + r)
            if f1 > best[0] + 1e-9 or abs(f1 - best[0]) <= 1e-9 and abs(limit - 0.5) < abs(best[1] - 0.5):
                best = (f1, float(limit), float(p), float(r))
        out[kind] = (trees, *best[1:])
    return out


def spans(texts: list[str], model: dict) -> list[list[tuple[int, int, str]]]:
    """The chosen (begin, end, type) of each text, in order and without overlap."""
    by_type: dict[int, list] = {t: [] for t in range(len(TYPES))}
    for i, text in enumerate(texts):
        for b, e, t in candidates(text):
            by_type[t].append((i, b, e, features(text, b, e, t)))
    chosen: list[list[tuple]] = [[] for _ in texts]
    for t, rows in by_type.items():
        if rows:
            trees, limit, *_ = model[TYPES[t]]
            score = _boosting.predict(trees, np.array([r[3] for r in rows], np.float64))
            for (i, b, e, _), s in zip(rows, score.tolist()):
                if s >= limit:
                    chosen[i].append((round(s, 2), e - b, b, e, TYPES[t]))
    out = []
    for found in chosen:
        kept: list[tuple[int, int, str]] = []
        for _, _, b, e, kind in sorted(found, key=lambda x: (-x[0], -x[1], x[2])):
            if all(e <= x or b >= y for x, y, _ in kept):
                kept.append((b, e, kind))
        out.append(sorted(kept))
    return out


def detected(documents: DataFrame) -> DataFrame:
    """doc_id, redacted (the text with placeholders) and found (array of begin, end, pii_type, pii_text) of each document."""
    model = documents.sparkSession.sparkContext.broadcast(fit())
    shape = "doc_id bigint, redacted string, found array<struct<begin:int,end:int,pii_type:string,pii_text:string>>"
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("pii_type", pa.string()), ("pii_text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            if part.num_rows:
                texts = part.column("text").to_pylist()
                redacted, found = [], []
                for text, marks in zip(texts, spans(texts, model.value)):
                    pieces, at = [], 0
                    for b, e, k in marks:
                        pieces += [text[at:b], f"[{k.upper()}]"]
                        at = e
                    redacted.append("".join([*pieces, text[at:]]))
                    found.append([{"begin": b, "end": e, "pii_type": k, "pii_text": text[b:e]} for b, e, k in marks])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(redacted, pa.string()), pa.array(found, kind)], ["doc_id", "redacted", "found"])

    return spread(documents.select("doc_id", "text")).where("doc_id is not null and text is not null").mapInArrow(work, shape)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.pii_type", "f.pii_text").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.col("redacted").alias("text"), F.size("found").alias("spans")).dropDuplicates(["doc_id"])


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and type: spans, and documents that hold any."""
    found = cut(_documents(spark, sf_dir).select("doc_id", F.explode("found.pii_type").alias("pii_type")), "p10-types")
    source = table(spark, sf_dir, "documents").select("doc_id", "source").dropDuplicates(["doc_id"])
    return found.join(source, "doc_id").groupBy("source", "pii_type").agg(F.count("*").alias("spans"), F.count_distinct("doc_id").alias("documents"))
