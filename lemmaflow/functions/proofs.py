"""Proof texts: sentences, edits and metrics.

Nested comments are not regular, so splitting a text into sentences needs a
lexer; it runs in Arrow UDFs, one batch at a time, once for each different text.
Everything that can be an expression over its output is one: metrics, distances and
the removal of tactics.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab

# Types as objects: workers import this module too, where no text of a type can be read.
SENTENCES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
CUT = T.StructType([T.StructField("body", T.StringType()), T.StructField("removed", T.ArrayType(T.StringType()))])
_TOKEN = re.compile(r'\(\*|\*\)|"|\.(?=[ \t\n\r]|\Z)')
_ESCAPING = re.compile(r'\(\*|\*\)|"|\.(?=[ \t\n\r]|\Z)|\\.', re.S)


def _any_of(words: list[str]) -> str:
    return "|".join(words)


# What marks a text: heads of declarations, and where proofs and blocks begin and end.
_HEAD = re.compile(rf"^\s*(?:{_any_of(vocab.PROOF_DECLARATIONS)})\s+", re.M)
_NAMED_HEAD = re.compile(rf"^\s*(?:{_any_of(vocab.LIFECYCLE_DECLARATIONS)})\s+(\w+)", re.M)
_BEGIN = re.compile(r"\bProof\s*\.")
_CLOSE = re.compile(rf"\b(?:{_any_of(vocab.TERMINALS)})\s*\.")
_BLOCK_END = re.compile(rf"\b(?:{_any_of(vocab.BLOCK_ENDS)})\b")
_HOLE = re.compile(vocab.HOLE)


def sentence_spans(text: str, escapes: bool = False) -> list[tuple[int, int]]:
    """Spans of sentences: each ends with a full stop before white space or the end, outside of comments and strings.

    With ``escapes`` a backslash in a string takes the character after it along."""
    token_of = _ESCAPING if escapes else _TOKEN
    spans, begin, depth, quoted, at = [], 0, 0, False, 0
    while m := token_of.search(text, at):
        at, token = m.end(), m[0]
        if quoted:
            quoted = token != '"'
            if token in ("(*", "*)"):
                at = m.start() + 1
        elif token[0] == "\\":
            at = m.start() + 1
        elif token == "(*":
            depth += 1
        elif depth:
            if token == "*)":
                depth -= 1
        elif token == '"':
            quoted = True
        elif token == "*)":
            at = m.start() + 1
        elif token == ".":
            spans.append((begin, at))
            begin = at
    if text[begin:].strip():
        spans.append((begin, len(text)))
    return spans


class Index:
    """Where a text's marks stand, each kind in one scan; proofs and blocks are looked up in the sorted places."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def heads(self) -> list[tuple[int, int]]:
        return [m.span() for m in _HEAD.finditer(self.text)]

    @cached_property
    def begins(self) -> list[tuple[int, int]]:
        return [m.span() for m in _BEGIN.finditer(self.text)]

    @cached_property
    def closes(self) -> list[tuple[int, int]]:
        return [m.span() for m in _CLOSE.finditer(self.text)]

    def _declares(self, name: str, at: int) -> bool:
        after = at + len(name)
        if not self.text.startswith(name, at):
            return False
        before, beyond = self.text[after - 1 : after], self.text[after : after + 1]
        word = lambda c: c.isalnum() or c == "_"
        return word(before) != word(beyond)

    def sentences(self, name: str) -> list[tuple[str, int, int]] | None:
        """The proof of the first declaration of a name, from behind ``Proof.`` to its terminal, sentence by sentence."""
        head = next((start for start, end in self.heads if self._declares(name, end)), None)
        if head is None:
            return None
        begin = bisect_left(self.begins, (head,))
        if begin == len(self.begins):
            return None
        lo = self.begins[begin][1]
        close = bisect_left(self.closes, (lo,))
        if close == len(self.closes):
            return None
        body = self.text[lo : self.closes[close][1]]
        return [(body[a:b], lo + a, lo + b) for a, b in sentence_spans(body) if body[a:b].strip()] or None

    @cached_property
    def open_names(self) -> list[str]:
        """Declarations with a hole before the next end of a block; blocks may run over later declarations."""
        holes = [m.span() for m in _HOLE.finditer(self.text)]
        ends = [m.start() for m in _BLOCK_END.finditer(self.text)]
        out = set()
        for m in _NAMED_HEAD.finditer(self.text):
            at, end = bisect_left(holes, (m.start(),)), bisect_left(ends, m.start())
            if at < len(holes) and (end == len(ends) or holes[at][1] <= ends[end]):
                out.add(m[1])
        return sorted(out)


def _per_text(texts: Iterable[str | None]) -> Iterator[Index | None]:
    """An index for each text of a batch; equal texts share one."""
    known: dict[str, Index] = {}
    for t in texts:
        yield None if t is None else known.setdefault(t, Index(t))


def _rows(found: list[tuple[str, int, int]] | None) -> list[dict] | None:
    return None if found is None else [{"text": t, "start": a, "end": b} for t, a, b in found]


@F.pandas_udf(SENTENCES)
def split_sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _rows([(t[a:b], a, b) for a, b in sentence_spans(t)]))


@F.pandas_udf(SENTENCES)
def extract_sentences(content: pd.Series, name: pd.Series) -> pd.Series:
    """The sentences of a declaration's proof; each different pair of a batch is read once."""
    known: dict[tuple[str, str], list[dict] | None] = {}
    out = []
    for index, n in zip(_per_text(content), name, strict=True):
        key = (index.text, n) if index and n is not None else None
        if key and key not in known:
            known[key] = _rows(index.sentences(n))
        out.append(known[key] if key else None)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def open_declarations(content: pd.Series) -> pd.Series:
    """Names of a content's declarations that still have a hole; none for a null content."""
    return pd.Series([index.open_names if index else [] for index in _per_text(content)])


def remove_last_tactics(content: Column, sentences: Column, n: Column) -> Column:
    """The content with the last n tactics of the proof that ``sentences`` is replaced by ``Admitted.``; null without a proof.

    n is cut to the tactics there are; with none to remove the content stays."""
    tactics = F.size(sentences) - 1
    gone = F.least(n, tactics)
    kept = tactics - gone
    end = F.when(kept > 0, F.try_element_at(sentences, kept)["end"]).otherwise(F.element_at(sentences, 1)["start"])
    indent = F.regexp_extract(F.element_at(sentences, kept + 1)["text"], r"(?U)\A\n*(\s*)", 1)
    rest = F.substring(content, F.element_at(sentences, -1)["end"] + 1, F.length(content))
    made = F.concat(F.substring(content, F.lit(1), end), F.lit("\n"), indent, F.lit("Admitted.\n"), rest)
    return F.when(sentences.isNull(), F.lit(None).cast("string")).when(gone <= 0, content).otherwise(made)


#: Sentences that are no steps of a proof, beside comments.
STRUCTURE = ("{", "}", "-", "+", "*", "--", "++", "**", "Proof.", "Qed.", "Defined.", "Admitted.")
CLOSERS = STRUCTURE[-3:]


def without_last_steps(body: str, n: int) -> tuple[str, list[str]]:
    """A proof's sentences, one a line, without its last n steps and its closers, and the steps removed.

    Steps are all sentences but bullets, braces, closers and what begins with a comment; those stay where they are."""
    lines = [t for a, b in sentence_spans(body, escapes=True) if (t := body[a:b].strip())]
    while lines and lines[-1] in CLOSERS:
        lines.pop()
    steps = [i for i, t in enumerate(lines) if t not in STRUCTURE and not t.startswith("(*")]
    gone = dict.fromkeys(steps[max(0, len(steps) - n) :]) if n > 0 else {}
    return "\n".join([*(t for i, t in enumerate(lines) if i not in gone), "  Admitted."]), [lines[i] for i in gone]


@F.pandas_udf(CUT)
def remove_last_steps(body: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The other removal, over a proof's body: by steps, with bullets and braces kept (`without_last_steps`); nulls for null."""
    made = [(None, None) if t is None or pd.isna(k) else without_last_steps(t, int(k)) for t, k in zip(body, n, strict=True)]
    return pd.DataFrame(made, columns=["body", "removed"])


def tactics_of(sentences: Column) -> Column:
    """Texts of sentences but for terminals."""
    texts = F.transform(sentences, lambda s: s["text"])
    return F.filter(texts, lambda t: ~t.rlike(rf"(?U)\A\s*(?:{'|'.join(vocab.TERMINALS)})\s*\."))


def tactic_names(sentences: Column) -> Column:
    """Leading identifiers of tactics, ``?`` where there is none."""
    name = lambda t: F.regexp_extract(t, r"(?U)\A\s*([a-zA-Z_]\w*)", 1)
    return F.transform(tactics_of(sentences), lambda t: F.when(name(t) == "", "?").otherwise(name(t)))


def tactic_count(sentences: Column) -> Column:
    return F.size(tactics_of(sentences))


def _automation_ratio(names: Column) -> Column:
    hits = F.size(F.filter(names, lambda n: n.isin(*vocab.AUTOMATION)))
    return F.when(F.size(names) == 0, F.lit(0.0)).otherwise(hits / F.size(names))


def _unique_tactics(names: Column) -> Column:
    return F.size(F.array_distinct(F.filter(names, lambda n: n != "?")))


def brace_depth(content: Column) -> Column:
    """Deepest nesting of braces; closing ones that match nothing count for nothing."""
    marks = F.split(F.regexp_replace(content, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = F.when(c == "{", s["now"] + 1).when(c == "}", F.greatest(s["now"] - 1, F.lit(0))).otherwise(s["now"])
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda s: s["most"])


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of names: each distinct name becomes one character, then the built-in one counts."""
    names = F.array_distinct(F.concat(a, b))
    # Characters from U+4E00 on are single code units, so up to 20,000 names keep apart.
    letters = lambda xs: F.array_join(F.transform(xs, lambda x: F.decode(_utf16(F.array_position(names, x) + 0x4E00), "UTF-16BE")), "")
    return F.levenshtein(letters(a), letters(b))


def _utf16(code: Column) -> Column:
    return F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0"))


def normalized_distance(distance: Column, human: Column, model: Column) -> Column:
    """Distance over the longer proof, 0 for two empty ones."""
    most = F.greatest(human, model)
    return F.when(distance.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(F.try_divide(distance, most), F.lit(0.0)))


def proof_metrics(sentences: Column) -> Column:
    """The text metrics of a proof as a struct, null without a proof; its names and text are made once."""

    def made(p: Column) -> Column:
        names, text = p["names"], p["text"]
        return F.struct(
            F.size(names).alias("tactic_count"),
            _automation_ratio(names).alias("automation_ratio"),
            _unique_tactics(names).alias("unique_tactic_types"),
            brace_depth(text).alias("max_bullet_depth"),
            F.length(text).alias("proof_chars"),
            (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("proof_lines"),
            text.rlike(r"(?U)\bAdmitted\s*\.").alias("ends_with_admitted"),
        )

    whole = F.struct(tactic_names(sentences).alias("names"), F.array_join(F.transform(sentences, lambda s: s["text"]), "").alias("text"))
    return F.when(sentences.isNotNull(), F.element_at(F.transform(F.array(whole), made), 1))
