"""The engine's own vocabulary: seven dimensions of labels, made by a rule from the syllables of the landed texts.

A rule row is (dimension, label, ord, any_of, all_of, exclude, requires_any, regex); see operators.rules.
"""

from __future__ import annotations

#: Dimensions of a document, and the syllables that terms are made of.
DIMENSIONS = ("operation", "material", "market", "component", "architecture", "process_technology", "machine_capability")
SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti to it st ou ing tion ly ble sh wh".split()
LABELS_EACH = 22
#: Labels of a market that mean nearly the same, and the components (by number) whose market is known.
CLUSTERS = ((0, 1, 2, 3), (4, 5, 6, 7))
KNOWN_COMPONENTS = 14
#: Words that deny or contrast, and words that assert.
NEGATION = ("not", "nicht", "pas", "non", "no")
PREDICATES = ("is", "are", "was", "est", "ist", "der", "en", "to")


def word(i: int) -> str:
    n = len(SYLLABLES)
    return SYLLABLES[i // n % n] + SYLLABLES[i % n]


def label(dimension: str, j: int) -> str:
    return f"{dimension}-{j:02d}"


def vocabulary(each: int = LABELS_EACH) -> list[tuple]:
    """All rules: single words, phrases and hyphened terms; some labels with required, excluded or accompanying terms or a pattern."""
    out = []
    for d, dimension in enumerate(DIMENSIONS):
        for j in range(each):
            a, b, c, e = (word(4 * (d * each + j) + m) for m in range(4))
            any_of = [] if j % 12 == 1 else [a, b, f"the {c}", f"{e}-{a}"]
            all_of = [c] if j % 6 == 1 else []
            exclude = [e] if j % 5 == 2 else []
            requires_any = ["the", "de", "und"] if j % 7 == 3 else []
            regex = [f"{SYLLABLES[j]}{SYLLABLES[d]}(?:ing|ed|ly)"] if j % 11 == 4 else []
            out.append((dimension, label(dimension, j), j, any_of, all_of, exclude, requires_any, regex))
    return out


def clusters() -> list[set[str]]:
    return [{label("market", j) for j in c} for c in CLUSTERS]


def market_of() -> dict[str, str]:
    """Market that a component belongs to, where that is known."""
    return {label("component", j): label("market", j) for j in range(KNOWN_COMPONENTS)}
