"""Word lists, patterns and tables of the proof-history domain.

They must equal what existing datasets were made with, so they are stated here as
plain text, together, and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: message patterns by signal, matched without regard to case ---
SIGNALS: dict[str, list[str]] = {
    "complete": [
        r"\bclose[ds]?\b", r"\bfill(?:ed|ing)?\b", r"\bfinish(?:ed|ing)?\b", r"\bsolv(?:e[ds]?|ing)\b",
        r"\bremov(?:e[ds]?|ing)\s+(?:sorry|admitted|oops)\b", r"\bno\s+(?:more\s+)?sorry\b", r"\bno\s+(?:more\s+)?admitted\b",
        r"\bqed\b", r"\bproof\s+complete\b", r"\bcomplete[ds]?\s+proof\b", r"\bresolv(?:e[ds]?|ing)\s+(?:goal|proof|sorry|admitted)\b",
    ],
    "new": [
        r"\badd(?:ed|ing)?\s+(?:lemma|theorem|corollary|proposition|fact)\b", r"\bnew\s+(?:lemma|theorem|corollary|proof)\b",
        r"\bprov(?:e[ds]?|ing)\s+\w+\b", r"\bproof\s+of\b", r"\blemma\b", r"\btheorem\b", r"\bcorollary\b",
    ],
    "add": [
        r"\bwip\b", r"\bwork\s+in\s+progress\b", r"\bpartial\b", r"\bprogress\b", r"\bmore\s+(?:cases|tactic|steps)\b", r"\btactic\b",
        r"\binduction\b", r"\brewrite\b", r"\bsimplif\b", r"\bapply\b", r"\bauto\b", r"\bomega\b", r"\bring\b", r"\bdestructur\b",
        r"\bcase\s+split\b", r"\bimprove\s+proof\b", r"\bclean\s+up\s+proof\b",
    ],
    "spec": [
        r"\bspecif(?:ication|y|ied)\b", r"\bstatement\b", r"\bgenerali[sz]e\b", r"\bstrengthen\b", r"\bweaken\b", r"\bprecondition\b",
        r"\bpostcondition\b", r"\bhypothes[ie]s\b", r"\bchanged?\s+(?:spec|statement|type|signature)\b",
        r"\bupdat(?:e[ds]?|ing)\s+(?:spec|statement|type)\b", r"\brelax\b", r"\brefin(?:e[ds]?|ing)\b",
    ],
    "infra": [
        r"\bbump\b", r"\bupgrad(?:e[ds]?|ing)\b", r"\bdependabot\b", r"\bdependency\b", r"\bdependencies\b", r"\bci\b",
        r"\bgithub\s+actions?\b", r"\bdocker\b", r"\bmakefile\b", r"\bnix\b", r"\bopam\b", r"\bsubmodule\b", r"\bchore\b", r"\brelease\b",
        r"\bversion\b",
    ],
    "refactor": [
        r"\brefactor\b", r"\brename\b", r"\bmov(?:e[ds]?|ing)\b", r"\breorganiz\b", r"\bclean(?:\s+up|up)?\b", r"\bextract\b",
        r"\bsplit\b", r"\bmerge\b", r"\bdedup\b", r"\bdeduplicat\b",
    ],
    "fix": [
        r"\bfix(?:es|ed|ing)?\b", r"\bbug\b", r"\bpatch\b", r"\bcorrect\b", r"\brepair\b", r"\bregression\b", r"\bissue\b",
        r"\bworkaround\b",
    ],
    "context": [r"\b(?:proof|lemma|theorem|sorry|admitted|oops|tactic|coq|corollary)\b"],
}

# --- Fixed values: tactics by behaviour ---
GROUPS: dict[str, list[str]] = {
    "rewrite_reduce": (
        "rewrite erewrite setoid_rewrite rewrite_strat replace symmetry transitivity etransitivity subst simpl cbn cbv lazy vm_compute "
        "native_compute compute unfold fold red hnf delta beta iota zeta change convert simp ring_nf ring_simplify field_simplify norm_cast "
        "push_cast pull_cast push_neg pull_neg pattern"
    ).split(),
    "hypothesis_management": "intro intros revert clear clearbody rename move generalize instantiate pose remember set assert cut enough have suff suffices".split(),
    "application": "apply eapply rapply lapply exact exact_no_check refine assumption auto eauto trivial easy specialize".split(),
    "meta_tactical": "repeat try first do progress timeout once solve fail idtac by done abstract".split(),
    "case_induction": "induction destruct case case_eq elim elimtype inversion inversion_clear injection split constructor econstructor left right exists eexists".split(),
    "contradiction_solver": "omega lia lra nia nra psatz contradiction absurd discriminate exfalso tauto btauto intuition firstorder decide congruence".split(),
    "arithmetic_algebra": "ring field norm_num zify".split(),
}
#: Tracked tactics of no group.
UNGROUPED = ["congr", "wlog", "without_loss", "reflect"]
GROUP_OF = {t: g for g, ts in GROUPS.items() for t in ts}
TACTICS = [*GROUP_OF, *UNGROUPED]

# --- Fixed values: keywords of messages ---
KEYWORDS = (
    "sorry admitted admit oops lemma theorem corollary proposition remark fact definition example instance canonical global local section module record "
    "proof qed defined abort end intro intros revert clear clearbody rename move destruct case case_eq induction inductive elim elimtype inversion inversion_clear "
    "injection discriminate constructor econstructor left right split exists eexists rewrite erewrite setoid_rewrite rewrite_strat replace symmetry transitivity "
    "etransitivity subst congruence apply eapply exact refine change convert rapply lapply specialize generalize instantiate pose remember set assert cut enough "
    "have suff suffices auto eauto tauto intuition firstorder trivial easy decide btauto contradiction absurd exfalso omega lia lra nia nra psatz ring field "
    "ring_simplify field_simplify norm_num zify push_cast pull_cast push_neg pull_neg simpl cbn cbv lazy vm_compute native_compute unfold fold red hnf compute "
    "delta beta iota zeta simp ring_nf push_ring by done congr wlog without_loss reflect iffP appP andP orP negP exact_no_check assumption solve fail idtac repeat "
    "try first do progress timeout once pattern abstract opaque transparent decide_eq boolean_reflect word wordring word_simpl cancel ring_simplify_subterms felem "
    "montgomery barrett modular prime group curve lattice hash cipher signature elliptic edwards weierstrass twisted x25519 x448 p256 p384 p521 secp256k1 "
    "curve25519 bedrock bedrock2 rupicola fiat crypto cryptographic protocol spec specification invariant postcondition precondition secp ecdsa ecdh rsa dh dsa"
).split()

# --- Fixed values: tactics that count as automation ---
AUTOMATION = (
    "auto eauto tauto intuition decide trivial omega lia linarith ring field norm_num firstorder solve_by_elim congruence reflexivity assumption "
    "contradiction exact discriminate"
).split()

# --- Fixed values: patterns of diffs and proof texts ---
HOLE = r"\b(?:sorry|Admitted|admit|oops)\b"
TERM_MODE = r"\bfun\s+\w|\bλ\s*\w|\bmatch\s+\w|\bfix\s+\w|\blet\s+\w+\s*:=|\bexist\s*[({]|\bconj\b"
SSREFLECT = r"^\s*(?:move|case|elim|apply|rewrite|have|suff|set|pose)\s*[/:\[\]]"
LIFECYCLE_DECLARATIONS = "Theorem Lemma Proposition Corollary Fact Remark Example Definition Fixpoint Program Inductive Record Class Instance".split()
PROOF_DECLARATIONS = LIFECYCLE_DECLARATIONS[:10]
BLOCK_ENDS = ["Qed", "Defined", "Abort", "End"]
TERMINALS = ["Qed", "Admitted", "Defined"]


@dataclass(frozen=True)
class Language:
    """How holes and declarations look in one proof assistant."""

    name: str
    extension: str
    markers: tuple[str, ...]
    declaration: str


# --- Fixed values: proof assistants ---
LANGUAGES = {
    "coq": Language("coq", ".v", ("Admitted", "admit"), r"^\s*(?:Theorem|Lemma|Proposition|Corollary|Fact|Remark|Example|Definition|Fixpoint|Program)\s+(\w+)"),
    "isabelle": Language("isabelle", ".thy", ("sorry", "oops"), r"^\s*(?:theorem|lemma|corollary|proposition|schematic_goal)\s+(\w+)"),
    "lean4": Language("lean4", ".lean", ("sorry",), r"^\s*(?:theorem|lemma|def|instance)\s+(\w+)"),
}
# --- Fixed values: folders that are no proof sources, and build files ---
SKIP_FOLDERS = [".git", ".jj", ".hg", "__pycache__", "node_modules", ".venv", "build"]
EXCLUDED_FOLDERS = ["vendor", "third_party", "external", "_build", "build", ".build", "node_modules", "__pycache__"]
# --- Fixed values: report buckets (label, largest count) ---
BUCKETS6 = [("1", 1), ("2-3", 3), ("4-5", 5), ("6-10", 10), ("11-20", 20), ("21+", None)]
BUCKETS7 = [("1", 1), ("2-3", 3), ("4-5", 5), ("6-10", 10), ("11-20", 20), ("21-50", 50), ("51+", None)]
DELETION_SIZES = [3, 5, 7, 10, 15]


def bank(name: str) -> str:
    """One alternation of a signal's patterns, for Java and RE2."""
    return "(?i)" + "|".join(SIGNALS[name])


def keyword_pattern() -> str:
    return r"(?i)\b(" + "|".join(KEYWORDS) + r")\b"


def tactic_pattern() -> str:
    """Tactics at a tactic position; the delimiters are consumed, so of two tactics that share one only the first counts."""
    return r"(?im)(?:^|[\s;|{(])(" + "|".join(TACTICS) + r")(?:\s|[.;()\[\]{]|$)"


def java(pattern: str) -> str:
    """A pattern with the flags that make classes and word bounds cover all letters in Java."""
    return pattern.replace("(?i", "(?iU", 1) if pattern.startswith("(?i") else "(?U)" + pattern
