"""Expressions on literal rows: decision tables, traps and edits."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lemmaflow import vocab
from lemmaflow.functions import commits as C
from lemmaflow.functions import proofs as P
from lemmaflow.functions import texts as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("subject", "body", "touches", "ins", "dels", "expected"),
    [
        ("Bump version", "", True, 1, 1, "infra"),
        ("Bump lemma version", "", True, 1, 1, "proof_new"),
        ("Close proof", "", False, 1, 1, "proof_complete"),
        ("lemma tweak", "", True, 1, 5, "proof_complete"),
        ("lemma tweak", "text", True, 1, 5, "proof_new"),
        ("Generalize it", "", True, 1, 1, "spec_change"),
        ("Generalize it", "", False, 1, 1, "other"),
        ("wip", "", True, 1, 1, "proof_add"),
        ("rename x", "", True, 1, 1, "proof_add"),
        ("rename x", "", False, 1, 1, "refactor"),
        ("fix x", "", False, 1, 1, "fix"),
        ("simplification", "", False, 1, 1, "other"),  # a stem that never matches its forms
        ("x", "", True, 1, 1, "proof_add"),
        (None, None, None, 1, 1, "other"),
    ],
)
def test_commit_class(spark, subject, body, touches, ins, dels, expected):
    df = spark.createDataFrame([(subject, body, touches, ins, dels)], "s string, b string, t boolean, i int, d int")
    assert df.select(C.commit_class(*map(F.col, "sbtid"))).first()[0] == expected


def test_keywords_keep_first_appearance(spark):
    assert one(spark, C.keywords(F.col("s"), F.col("b")), s="Rewrite LEMMA with case_eq", b="rewrite p256 iffp") == ["rewrite", "lemma", "case_eq", "p256", "iffp"]


def test_tables():
    assert sum(map(len, vocab.GROUPS.values())) == len(vocab.GROUP_OF) == 116
    assert {g: len(t) for g, t in vocab.GROUPS.items()} == {"rewrite_reduce": 36, "hypothesis_management": 18, "application": 13, "meta_tactical": 13, "case_induction": 16, "contradiction_solver": 16, "arithmetic_algebra": 4}
    assert len(set(vocab.KEYWORDS)) == len(vocab.KEYWORDS) == 199


def test_groups_leave_out_unknown(spark):
    assert one(spark, C.tactic_groups(F.col("t")), t=["LIA", "congr", "nia", "intro"]) == ["contradiction_solver", "hypothesis_management"]


def diffed(spark, diff):
    return C.with_diff_signals(spark.createDataFrame([(diff,)], "diff string")).first()


def test_delimiter_is_consumed(spark):
    assert diffed(spark, "+repeat rewrite x")["tactic_tags"] == ["repeat"]


@pytest.mark.parametrize(
    ("added", "style"),
    [
        ("move: x => fun y", ["ssreflect", "mixed"]),
        ("rewrite /x fun y", ["ssreflect", "mixed"]),
        ("move/x y", ["ssreflect"]),
        ("foo (conj a b) (fun x => x)", ["term_mode"]),
        ("lia.", ["tactic_mode"]),
        ("lia. match x", ["mixed"]),
        ("nothing here", ["unknown"]),
    ],
)
def test_styles(spark, added, style):
    got = diffed(spark, f"+{added}")["proof_style"]
    if style == ["ssreflect", "mixed"] and not diffed(spark, f"+{added}")["tactic_tags"]:
        style = ["ssreflect", "term_mode"]
    assert got == style


def test_empty_diff(spark):
    for d in (None, ""):
        r = diffed(spark, d)
        assert (r["tactic_tags"], r["proof_style"], r["sorry_removed"], r["net_proof_lines"]) == ([], [], False, 0)


def test_headers_do_not_count(spark):
    r = diffed(spark, "--- a\n+++ b\n-Admitted.\n+Qed.")
    assert (r["sorry_removed"], r["added_count"], r["removed_count"]) == (True, 1, 1)


def test_sentences():
    spans = lambda t: [t[a:b] for a, b in P.sentence_spans(t)]
    assert spans("a. (* x. (* y. *) z. *) b.") == ["a.", " (* x. (* y. *) z. *) b."]
    assert spans('f "a. b". Nat.add x. tail') == ['f "a. b".', " Nat.add x.", " tail"]
    assert spans("") == []


def char_by_char(text):
    """An independent reading of the rule, one character at a time."""
    out, begin, depth, quoted, i = [], 0, 0, False, 0
    while i < len(text):
        two = text[i : i + 2]
        if quoted:
            quoted = text[i] != '"'
        elif two == "(*":
            depth += 1
            i += 1
        elif depth:
            if two == "*)":
                depth -= 1
                i += 1
        elif text[i] == '"':
            quoted = True
        elif text[i] == "." and (i + 1 == len(text) or text[i + 1] in " \t\n\r"):
            out.append((begin, i + 1))
            begin = i + 1
        i += 1
    return out + [(begin, len(text))] if text[begin:].strip() else out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='a.(*)" \n', max_size=40))
def test_sentences_property(text):
    assert P.sentence_spans(text) == char_by_char(text)


PROOF = "Lemma a : x.\nProof.\n  intros.\n  lia.\nQed.\n"


def test_remove_last(spark):
    cut = lambda text, name, n: one(spark, P.remove_last_tactics(F.col("c"), P.extract_sentences(F.col("c"), F.col("d")), F.col("n")), c=text, d=name, n=n)
    assert cut(PROOF, "a", 1) == "Lemma a : x.\nProof.\n  intros.\n  Admitted.\n\n"
    assert cut(PROOF, "a", 0) == PROOF
    assert cut(PROOF, "a", 99) == cut(PROOF, "a", 2) == "Lemma a : x.\nProof.\n  Admitted.\n\n"
    assert cut(PROOF, "b", 1) is None
    assert cut("é" + PROOF, "a", 1) is None and cut("(*é*)\n" + PROOF, "a", 1) == "(*é*)\nLemma a : x.\nProof.\n  intros.\n  Admitted.\n\n"
    assert cut("Lemma a : x.\nProof.\n\n\tlia. Qed. tail", "a", 1) == "Lemma a : x.\nProof.\n\tAdmitted.\n tail"


def test_declared_names():
    index = P.Index("Lemma a' : x.\nProof. one. Qed.\nLemma a : y.\nProof. two. Qed.\nLemma ab.\n")
    assert [t for t, _, _ in index.sentences("a")] == [" one.", " Qed."]  # a name ends where its word does
    assert index.sentences("ab") is None and index.sentences("b") is None


def test_remove_last_steps(spark):
    body = "\n  intros.\n  { (* note. *)\n split. }\n - auto. (f \"a \\\" b. c\").\nQed."
    assert P.without_last_steps(body, 1) == ('intros.\n{ (* note. *)\n split.\n}\n - auto.\n  Admitted.', ['(f "a \\" b. c").'])
    assert P.without_last_steps(body, 99)[0] == "  Admitted." and len(P.without_last_steps(body, 99)[1]) == 4
    assert P.without_last_steps("a. (* c *) b. }", 1) == ("(* c *) b.\n}\n  Admitted.", ["a."])
    assert P.without_last_steps("a. -. b. }. Defined. Qed.", 1) == ("a.\n-.\nb.\n  Admitted.", ["}."])
    assert P.without_last_steps("", 3) == ("  Admitted.", []) and P.without_last_steps("a. Qed.", 0) == ("a.\n  Admitted.", [])
    got = one(spark, P.remove_last_steps(F.col("c"), F.col("n")), c="a. b. Qed.", n=1)
    assert (got["body"], got["removed"]) == ("a.\n  Admitted.", ["b."])


def test_patch(spark):
    f = lambda c, n, t: one(spark, X.patch_admitted(F.col("c"), F.col("n"), F.col("t")), c=c, n=n, t=t)
    assert f("Lemma a.\nProof.\n  Admitted.\nend", "Lemma a", "auto.\n\nQed.") == "Lemma a.\nProof.\n  auto.\n\n  Qed.\nend"
    assert f("Lemma a.", "Lemma a", "x") == "Lemma a."
    assert f("x\nAdmitted.\n", "nowhere", "x") == "x\nAdmitted.\n"


@pytest.mark.parametrize(("a", "b", "n"), [([], [], 0), (["x"], [], 1), (list("kitten"), list("sitting"), 3), (["auto", "lia"], ["lia"], 1)])
def test_edit_distance(spark, a, b, n):
    assert one(spark, P.edit_distance(F.col("a"), F.col("b")), a=a, b=b) == n


def test_depth(spark):
    assert one(spark, P.brace_depth(F.col("c")), c="}{ {x} } {") == 2
    assert one(spark, P.brace_depth(F.col("c")), c="") == 0


def test_first_bytes(spark):
    assert one(spark, X.first_bytes(F.col("t"), 3), t="aéb") == "aé"
    assert one(spark, X.first_bytes(F.col("t"), 2), t="aéb") == "a�"


def test_axioms(spark):
    assert one(spark, X.axioms(F.col("t")), t="x\nAxioms:\n a : nat\nb\n\nc : x") == ["a", "b"]
    assert one(spark, X.axioms(F.col("t")), t="Axioms: z : y\nClosed under the global context.\nq") == ["z"]
    assert one(spark, X.axioms(F.col("t")), t="") == []


def test_versions(spark):
    none = F.lit(None).cast("string")
    opam = "coq-version:\n  - 'dev'\n  - '8.20.0'\n"
    assert one(spark, X.detected_version(none, F.col("t"), none, none), t=opam) == "8.20"
    assert one(spark, X.detected_version(F.col("t"), none, none, none), t='DOCKER_COQ_VERSION: "dev"') == "dev"
    assert one(spark, X.detected_version(none, none, none, F.col("t")), t='COQ_VERSION="v8.9" COQ_PACKAGE="coq-8.9.1"') == "8.9.1"


def test_holes_of_blocks(spark):
    open_ = lambda t: P.Index(t).open_names
    assert open_("Lemma a : x. admit. Qed.") == ["a"]
    assert open_("Lemma a : x. Qed. Admitted.") == []
    assert open_("Lemma a : x.\nLemma b : y. Admitted. End") == ["a", "b"]  # a block runs over the next declaration
    assert open_("Lemma a : x. Qed.\nLemma a : x. oops.") == ["a"] and open_("") == []
    assert open_("Lemma a : AdmittedEnd. End") == []
    assert one(spark, P.open_declarations(F.col("t")), t=None) == []


def test_byte_size(spark):
    assert [one(spark, X.byte_size(F.col("n")), n=n) for n in (5, 2500, 2_500_000)] == ["5 B", "2.5 KB", "2.5 MB"]


def test_patterns_compile():
    for p in (vocab.keyword_pattern(), vocab.tactic_pattern(), vocab.HOLE, vocab.TERM_MODE, vocab.SSREFLECT, *map(vocab.bank, vocab.SIGNALS)):
        re.compile(p)
