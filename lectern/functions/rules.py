"""Rewrite rules, written once and rendered for Java (Spark) and RE2 (DuckDB).

`ahead` is what must follow a match without being part of it: a lookahead in
Java, a captured and re-emitted group in RE2. `word` asks for an ASCII word
boundary in front, which Java's own \\b isn't.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    out: str
    ahead: str = ""
    word: bool = False
    behind: str = ""
    passes: int = 1

    def java(self) -> tuple[str, str]:
        pattern, front = self.pattern, f"(?<={self.behind})" if self.behind else ""
        if self.word:  # the boundary is tested behind the first word, so that its letters are searched for
            first = re.match(r"[A-Za-z]+(?: [a-z]+)?", pattern)[0]
            pattern = f"{first}(?<![A-Za-z0-9_]{first}){pattern[len(first):]}"
        return front + pattern + (f"(?={self.ahead})" if self.ahead else ""), self.out

    def re2(self) -> tuple[str, str]:
        """Groups: `behind`, then those of the pattern (at most one, and never with `behind`), then `ahead`."""
        groups = self.pattern.count("(") - self.pattern.count("(?") - self.pattern.count(r"\(")
        front = r"\b" if self.word else f"({self.behind})" if self.behind else ""
        out = self.out.replace("$1", r"\1")
        if self.behind:
            out = r"\1" + out
        if self.ahead:
            out += f"\\{groups + bool(self.behind) + 1}"
        return front + self.pattern + (f"({self.ahead})" if self.ahead else ""), out


# What the voice says instead, in the order in which it applies.
SPEECH = (
    Rule(r"Figs\.\s*", "Figures ", r"[0-9]", word=True),
    Rule(r"Fig\.\s*", "Figure ", r"[0-9]", word=True),
    Rule(r"Eqs\.\s*", "Equations ", r"\(?[0-9]", word=True),
    Rule(r"Eq\.\s*", "Equation ", r"\(?[0-9]", word=True),
    Rule(r"Eqn\.\s*", "Equation ", r"\(?[0-9]", word=True),
    Rule(r"Secs\.\s*", "Sections ", r"[0-9]", word=True),
    Rule(r"Sec\.\s*", "Section ", r"[0-9]", word=True),
    Rule(r"Tab\.\s*", "Table ", r"[0-9]", word=True),
    Rule(r"Refs\.\s*", "References ", r"[0-9\[]", word=True),
    Rule(r"Ref\.\s*", "Reference ", r"[0-9\[]", word=True),
    Rule(r"Alg\.\s*", "Algorithm ", r"[0-9]", word=True),
    Rule(r"Appx\.\s*", "Appendix ", r"[A-Z0-9]", word=True),
    Rule(r"e\.g\.,?", "for example,", word=True),
    Rule(r"i\.e\.,?", "that is,", word=True),
    Rule(r"cf\.\s", "compare ", word=True),
    Rule(r"vs\.?\s", "versus ", word=True),
    Rule(r"w\.r\.t\.\s", "with respect to ", word=True),
    Rule(r"approx\.\s", "approximately ", word=True),
    Rule(r"et al\.", "et al", r"\s+[a-z(,;]", word=True),
    Rule("×", " times "),
    Rule("±", " plus or minus "),
    Rule("≈", " approximately "),
    Rule("≤", " at most "),
    Rule("≥", " at least "),
    Rule("→", " to "),
    Rule(r"(^|\s)[∼~]", "$1about ", r"[0-9]"),
    Rule("%", " percent"),
    Rule("°", " degrees"),
    Rule(r"\s&\s", " and "),
    Rule(r"\^−([0-9]+)", " to the power of minus $1"),
    Rule(r"\^([0-9]+)", " to the power of $1"),
    Rule("−", "minus ", r"[0-9]"),
    Rule(r"\s−\s", " minus "),
    Rule("[–−]", "-", r"[0-9]", behind=r"[0-9]", passes=2),
    Rule("[•●■◆▪]", ""),
)
CLEANUP = (
    Rule(r"\(\s*\)", ""),
    Rule(r"\[\s*\]", ""),
    Rule(r"\s+([,.;:!?])", "$1"),
    Rule(r"[,;:]\s*", "", r"[,;:]", passes=4),
    Rule(r"\(\s*,\s*", "("),
    Rule(r"\s{2,}", " "),
    Rule(r"^\s+", ""),
    Rule(r"\s+$", ""),
)

# The shape of a citation segment.
_YEAR = r"(?:1[6-9]|20)[0-9]{2}[a-z]?"
_LEAD = r"(?:(?:e\.g\.|i\.e\.|see|cf\.|see also|also|for example|and|as in|following|after|inter alia|in)[,\s]+)*"
_SEGMENT = rf"{_LEAD}(?:[A-Z][^,;()]*?[,\s]+)?{_YEAR}(?:\s*,?\s*{_YEAR})*(?:[,\s]+(?:p+\.|chap\.|ch\.|§|sec\.)?\s*[0-9]+(?:[-–][0-9]+)?)?"
NUMERIC_CITATION = r"\s?\[\s*[0-9]{1,3}(?:\s*[,;–\-]\s*[0-9]{1,3})*\s*\]"
_LIST = rf"[\s;]*{_SEGMENT}\s*(?:;[\s;]*{_SEGMENT}\s*)*[\s;]*"
CITATION_JAVA = rf"\s?\((?=[^()]{{2,200}}\)){_LIST}\)"
CITATION_RE2 = rf"\s?\({_LIST}\)"


def apply_rules(col: Column, rules: tuple[Rule, ...]) -> Column:
    """The rules in order. `$` at an end is made absolute."""
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r.java()[0].replace("\\s+$", "\\s+\\z")), F.lit(r.java()[1])), rules, col)


def strip_citations(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, NUMERIC_CITATION, ""), CITATION_JAVA, "")


#: What any abbreviation, and any symbol rule, needs in a text; other texts skip the whole group.
ABBREVIATED = r"(?:Figs?|Eq[sn]?|Secs?|Tab|Refs?|Alg|Appx|e\.g|i\.e|cf|w\.r\.t|approx|et al)\.|vs[.\s]"
SYMBOLS = "[×±≈≤≥→∼~%°&^−–•●■◆▪]"
GROUPS = ((ABBREVIATED, tuple(r for r in SPEECH if r.word)), (SYMBOLS, tuple(r for r in SPEECH if not r.word)))


def let(col: Column, body) -> Column:
    """body(x) with x bound to col's value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(col), body), 1)


def guarded(col: Column, pattern: str, body) -> Column:
    return let(col, lambda x: F.when(x.rlike(pattern), body(x)).otherwise(x))


def speech_rules(col: Column) -> Column:
    """All speech rules in order; each group stands behind one test for what any of its rules needs."""
    for needed, rules in GROUPS:
        col = guarded(col, needed, lambda x, rules=rules: apply_rules(x, rules))
    return col


def clean_for_speech(col: Column, citations: bool = True) -> Column:
    stripped = guarded(col, r"[\[(]", strip_citations) if citations else col
    return apply_rules(speech_rules(stripped), CLEANUP)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_rules(expr: str, rules: tuple[Rule, ...]) -> str:
    """The same chain as DuckDB SQL; a rule whose neighbours share a character runs as often as `passes` says."""
    for r in rules:
        pattern, out = r.re2()
        for _ in range(r.passes):
            expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(out)}, 'g')"
    return expr


def sql_citations(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, {quoted(NUMERIC_CITATION)}, '', 'g'), {quoted(CITATION_RE2)}, '', 'g')"
