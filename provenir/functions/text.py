"""Text measures and normalisers as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def newlines(text: Column | str) -> Column:
    """CR LF and CR as LF; null as ''."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\r\n?", "\n")


def line_count(text: Column | str) -> Column:
    """Lines as universal line ends part them; a trailing end begins no line, '' has none."""
    t = _c(text)
    ends = r"\R|[\x1c-\x1e]"
    return F.when(t == "", 0).when(t.isNotNull(), F.size(F.split(F.regexp_replace(t, rf"(?:{ends})\z", ""), ends, -1)))


def physical_line_count(text: Column | str) -> Column:
    """line_count, but at least 1 for text that isn't ''."""
    t = _c(text)
    return F.when(t == "", 0).otherwise(F.greatest(line_count(t), F.lit(1)))


def word_count(text: Column | str) -> Column:
    """Runs of anything but Unicode white space; null for null."""
    t = _c(text)
    return F.when(t.isNotNull(), F.size(F.filter(F.split(t, r"(?U)[\s\x1c-\x1f]+", -1), lambda x: x != "")))


def space_tokens(text: Column | str) -> Column:
    """Literal-space tokens of the text without its outer line feeds: one more than it has spaces."""
    t = F.regexp_replace(_c(text), r"^\n+|\n+$", "")
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1


def space_weight(text: Column | str) -> Column:
    """Literal-space tokens of the text as it stands."""
    t = _c(text)
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1


def pair_id(idx: Column | str) -> Column:
    """idx without a trailing _human, _lm or _ai."""
    return F.regexp_replace(_c(idx), "_(human|lm|ai)$", "")


def pair_label(idx: Column | str) -> Column:
    """human or lm (ai counts as lm) from the suffix of idx; null where there is none."""
    found = F.regexp_extract(_c(idx), "_(human|lm|ai)$", 1)
    return F.when(found == "human", "human").when(found.isin("lm", "ai"), "lm")


def normal_label(label: Column | str, digits: bool = True) -> Column:
    """human or lm from a label in any case and with blanks; with digits 1 is human and 0 is lm; null for others."""
    x = F.lower(F.trim(_c(label)))
    out = F.when(x == "human", "human").when(x.isin("lm", "ai", "machine", "agc", "mgc"), "lm")
    return out.when(x == "1", "human").when(x == "0", "lm") if digits else out


def truthy(value: Column | str) -> Column:
    """True for 1, true, t, yes and y; False for 0, false, f, no, n and blank; null for null and others."""
    x = F.lower(F.trim(_c(value).cast("string")))
    return F.when(x.isin("1", "true", "t", "yes", "y"), True).when(x.isin("0", "false", "f", "no", "n", ""), False)


def warned(value: Column | str, any_text: bool = False) -> Column:
    """Whether a warning text says something: blank and null never; 0, false, f, no and n only with any_text."""
    x = F.lower(F.trim(F.coalesce(_c(value), F.lit(""))))
    return (x != "") & (F.lit(True) if any_text else ~x.isin("0", "false", "f", "no", "n"))


def language_of_path(path: Column | str) -> Column:
    """python, java or cpp by the ending of a path, else null."""
    p = F.lower(_c(path))
    return F.when(p.endswith(".py"), "python").when(p.endswith(".java"), "java").when(p.rlike(r"\.(?:cpp|cc|cxx|hpp|h)$"), "cpp")


def leaf_name(qualified: Column | str) -> Column:
    """What follows the last dot of a qualified name."""
    return F.element_at(F.split(_c(qualified), r"\."), -1)


def first_name(code: Column | str) -> Column:
    """The name of the first function, else of the first class, else <anon>."""
    c = _c(code)
    function = F.regexp_extract(c, r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(", 1)
    kind = F.regexp_extract(c, r"(?m)^\s*class\s+(\w+)", 1)
    return F.coalesce(F.nullif(function, F.lit("")), F.nullif(kind, F.lit("")), F.lit("<anon>"))


def until_marker(text: Column | str, marker: str = "<|endoftext|>") -> Column:
    """The text before the first marker."""
    return F.substring_index(_c(text), marker, 1)


def without_fences(text: Column | str) -> Column:
    """What stands inside the first code fence, or the text where there is none."""
    t = _c(text)
    inside = F.regexp_extract(t, r"(?s)```[\w+-]*\n(.*?)(?:```|\z)", 1)
    return F.when(t.rlike(r"```[\w+-]*\n"), inside).otherwise(t)


def docstring_split(text: Column | str) -> tuple[Column, Column]:
    """Prompt (up to and with the first docstring) and body of a function whose docstring has triple double quotes; nulls where there is none."""
    parts = F.split(F.regexp_replace(_c(text), "'''", '"""'), '"""', -1)
    whole = F.size(parts) >= 3
    prompt = F.concat(parts[0], F.lit('"""'), parts[1], F.lit('"""'))
    return F.when(whole, prompt), F.when(whole, F.array_join(F.slice(parts, F.lit(3), F.size(parts)), '"""'))


def escape_braces(text: Column | str) -> Column:
    return F.replace(F.replace(_c(text), F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def safe_label(text: Column | str) -> Column:
    """A label fit for a path: runs of other signs than letters, digits, dot, dash and underscore become one underscore."""
    return F.regexp_replace(_c(text), r"[^A-Za-z0-9._-]+", "_")


def length_bin(tokens: Column | str) -> Column:
    """typeNN_LLL for 100 to 200 tokens in ten bins (the first has 100 too), else under_100 or over_200."""
    n = _c(tokens)
    k = F.when(n <= 110, F.lit(1)).otherwise(F.floor((n - 101) / 10) + 1).cast("int")
    return F.when(n < 100, "under_100").when(n > 200, "over_200").when(n.isNotNull(), F.format_string("type%02d_%d", k, k * 10 + 100))


def byte_offset(text: Column | str, chars: Column) -> Column:
    """UTF-8 bytes before a character offset."""
    return F.octet_length(F.substring(_c(text), F.lit(1), chars.cast("int")))


def last_split(value: Column | str, mark: str = "__") -> tuple[Column, Column]:
    """What stands before and after the last mark; null after it where there is none."""
    v = _c(value)
    pattern = rf"(?s)^(.*){mark}(.*)$"
    return F.when(v.rlike(pattern), F.regexp_extract(v, pattern, 1)).otherwise(v), F.when(v.rlike(pattern), F.regexp_extract(v, pattern, 2))


def short_run(value: Column | str) -> Column:
    """A run's name before the size that follows it: text before the first _<number>_."""
    return F.regexp_extract(_c(value), r"^(.*?)(?:_\d+_.*)?$", 1)


def first_key(value: Column | str, keys: list[str]) -> Column:
    """The first of the keys that the value holds, case aside, else null."""
    v, out = F.lower(_c(value)), None
    for k in keys:
        out = (F if out is None else out).when(F.contains(v, F.lit(k.lower())), k)
    return out if out is not None else F.lit(None).cast("string")


def sample_id(*parts: Column | str) -> Column:
    """The parts that aren't null, joined by underscores."""
    return F.concat_ws("_", *[_c(p).cast("string") for p in parts])


def few_shot_prompt(head: str, examples: Column | str, question: Column | str) -> Column:
    """A prompt from a head, an array of (input, output) examples and a question."""
    shots = F.transform(_c(examples), lambda e: F.concat(F.lit("Input:\n"), e["input"], F.lit("\nOutput: "), e["output"].cast("string")))
    return F.concat_ws("\n\n", F.lit(head), shots, F.concat(F.lit("Input:\n"), _c(question), F.lit("\nOutput:")))


# Fixed value: the head of the question whether a text was generated.
LABEL_HEAD = (
    "You will be provided with a {lang} source code. Please determine if the code snippet is generated by Artificial intelligence (AI) models (i.e. language models) or human. If the code is generated by human, output 1. "
    "If the code is generated by AI, output 0. A few example source code along with their corresponding labels are also provided. Return only the label in the output."
)


def label_prompt(lang: str, examples: Column | str, question: Column | str) -> Column:
    """The question for a label: head, an array of (input, output) examples and the text with its braces escaped, parted by blank lines."""
    shots = F.transform(_c(examples), lambda e: F.concat(F.lit("Input: "), e["input"], F.lit(" -> Output: "), e["output"].cast("string")))
    return F.concat_ws("\n\n", F.lit(LABEL_HEAD.format(lang=lang)), shots, F.concat(F.lit("Input: "), escape_braces(question), F.lit(" -> Output:")))


def block_text(value: Column | str) -> Column:
    """A block without blanks at its end and with one line end; a blank one is an empty function."""
    v = F.regexp_replace(F.coalesce(_c(value), F.lit("")), r"(?U)\s+$", "")
    return F.when(v == "", "def _empty_block(): pass\n").otherwise(F.concat(v, F.lit("\n")))


def agc_score(human: Column | str, mode: Column | str) -> Column:
    """The machine's score from the human one: its negative for decisions, 1 less it for probabilities; another mode is an error."""
    h, m = _c(human), _c(mode)
    return F.when(m == "decision", -h).when(m == "proba", 1 - h).when(m.isNotNull() & h.isNotNull(), F.raise_error(F.concat(F.lit("unsupported score mode: "), m)).cast("double"))


def mode_threshold(mode: Column | str, given: Column | None = None) -> Column:
    """The threshold given, else the mode's own: 0 for decisions, 0.5 for probabilities."""
    own = F.when(_c(mode) == "decision", 0.0).when(_c(mode) == "proba", 0.5)
    return F.coalesce(given, own) if given is not None else own
