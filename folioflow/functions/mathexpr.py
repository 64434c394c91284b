"""Math expressions: tokens, a compact source language to MathML, bracket repair, as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NS = "http://www.w3.org/1998/Math/MathML"
# Command names and what they stand for.
GREEK = dict(
    alpha="α", beta="β", gamma="γ", delta="δ", epsilon="ε", varepsilon="ϵ", zeta="ζ", eta="η", theta="θ", vartheta="ϑ", iota="ι", kappa="κ",
    mu="μ", nu="ν", xi="ξ", omicron="ο", pi="π", varpi="ϖ", rho="ρ", varrho="ϱ", sigma="σ", varsigma="ς", tau="τ", upsilon="υ", phi="φ",
    varphi="ϕ", chi="χ", psi="ψ", omega="ω", Gamma="Γ", Delta="Δ", Theta="Θ", Lambda="Λ", Xi="Ξ", Pi="Π", Sigma="Σ", Upsilon="Υ", Phi="Φ",
    Psi="Ψ", Omega="Ω",
) | {"lambda": "λ"}
OPERATORS = dict(
    cdot="⋅", times="×", div="÷", pm="±", mp="∓", le="≤", leq="≤", ge="≥", geq="≥", ne="≠", neq="≠", approx="≈", equiv="≡", propto="∝",
    to="→", rightarrow="→", leftarrow="←", leftrightarrow="↔", infty="∞", partial="∂", nabla="∇", sum="∑", prod="∏", int="∫", oint="∮",
    therefore="∴", because="∵", perp="⟂", parallel="∥", angle="∠", degree="°",
)
FUNCTIONS = {"sin", "cos", "tan", "cot", "sec", "csc", "sinh", "cosh", "tanh", "ln", "log", "exp", "lim", "max", "min"}
STYLES = {"mathrm": "normal", "mathbf": "bold", "mathit": "italic"}
FENCES = {"(": ")", "[": "]", "|": "|"}

TOKEN = re.compile(
    r"(?P<space>\s+)|\\(?P<command>[A-Za-z]+|.|$)|(?P<mark>[{}_^])|(?P<number>[0-9][0-9.,]*|[.,](?=[0-9])[0-9.,]*)"
    r"|(?P<identifier>[A-Za-zΑ-Ωα-ωΆ-ώϐ-ϖ]+)|(?P<operator>[-+=<>/⋅×·±∓≈≠≤≥→←↔⇔∞∂∇∑∫∏()\[\]|,:;])|(?P<other>.)",
    re.S,
)


class MathError(ValueError):
    pass


def strip_dollars(source: str | None) -> str:
    return re.sub(r"^\s*\$+|\$+\s*$", "", source or "").strip()


def tokenize(source: str | None) -> list[tuple[str, str]]:
    """(kind, text) pairs; white space separates and goes. Characters of no other kind are identifiers."""
    out = []
    for m in TOKEN.finditer(strip_dollars(source)):
        kind = m.lastgroup
        if kind != "space":
            out.append((m[kind] if kind == "mark" else "identifier" if kind == "other" else kind, m[kind]))
    return out


def tag(name: str, inner: str = "", **attrs: str) -> str:
    return f"<{name}{''.join(f' {k}="{v}"' for k, v in attrs.items())}>{inner}</{name}>"


def text(value: str) -> str:
    return escape(value, quote=False).replace('"', "&quot;").replace("'", "&apos;")


def fence(char: str) -> str:
    return tag("mo", text(char), stretchy="true")


@dataclass
class Row:
    """An open sequence: its items so far as [base, subscript, superscript], what closes it, and what its MathML is put into."""

    close: tuple[str, str] | None = None
    wrap: Callable[[str], str] = str
    items: list[list[str]] = field(default_factory=list)

    def done(self) -> str:
        return self.wrap(tag("mrow", "".join(map(marked, self.items))))


@dataclass
class Call:
    """A construct that waits for operands; a script waits for one and gives it to the last item of the row below."""

    arity: int
    build: Callable[..., str] = str
    slot: int = 0
    operands: list[str] = field(default_factory=list)


def marked(item: list[str]) -> str:
    base, low, high = item
    name = {(True, False): "msub", (False, True): "msup", (True, True): "msubsup"}.get((bool(low), bool(high)))
    return tag(name, base + low + high) if name else base


def fenced(first: str, last: str) -> Callable[[str], str]:
    return lambda inner: tag("mrow", fence(first) + inner + fence(last))


def styled(variant: str) -> Callable[[str], str]:
    return lambda inner: tag("mstyle", inner, mathvariant=variant)


#: What a command opens; all others are leaves.
CALLS: dict[str, tuple[int, Callable[..., str]]] = {
    "left": (1, str),
    "right": (1, str),
    "frac": (2, lambda over, under: tag("mfrac", over + under)),
    "sqrt": (1, lambda inner: tag("msqrt", inner)),
    "paren": (1, fenced("(", ")")),
    "bracket": (1, fenced("[", "]")),
} | {name: (1, styled(variant)) for name, variant in STYLES.items()}
#: Leaves by name, in the order in which a name is looked up.
NAMED = {k: tag("mi", v) for k, v in GREEK.items()} | {k: tag("mo", v) for k, v in OPERATORS.items()} | {k: tag("mi", k, mathvariant="normal") for k in FUNCTIONS}
SLOTS = {"_": 1, "^": 2}


def leaf(kind: str, value: str) -> str:
    if kind == "command":
        return NAMED.get(value) or tag("mi", text(value))
    if kind == "number":
        return tag("mn", text(value.replace(",", ".", 1)))
    if kind == "operator":
        return fence(value) if value in ")]" else tag("mo", text(value))
    return tag("mi", text(value))


def literal(tokens: list[tuple[str, str]], at: int) -> tuple[str, int]:
    """The plain text of a braced group that begins at `at`, and the place behind it."""
    if at >= len(tokens) or tokens[at][0] != "{":
        raise MathError(r"\text needs {...}")
    depth = 0
    for i in range(at, len(tokens)):
        depth += {"{": 1, "}": -1}.get(tokens[i][0], 0)
        if not depth:
            return "".join(value for _, value in tokens[at + 1 : i]), i + 1
    raise MathError(r"a closing } is missing in \text")


def body(source: str) -> str:
    """MathML of one expression: tokens are shifted onto a stack of open rows and calls, and what is complete is reduced."""
    tokens, stack, at = tokenize(source), [Row()], 0

    def reduce(value: str) -> None:
        while True:
            top = stack[-1]
            if isinstance(top, Row):
                top.items.append([value, "", ""])
                return
            if top.slot:
                stack.pop()
                stack[-1].items[-1][top.slot] = value
                return
            top.operands.append(value)
            if len(top.operands) < top.arity:
                return
            stack.pop()
            value = top.build(*top.operands)

    while at < len(tokens):
        kind, value = tokens[at]
        top, at = stack[-1], at + 1
        in_row = isinstance(top, Row)
        if in_row and top.close == (kind, value):
            stack.pop()
            reduce(top.done())
        elif kind == "}":
            raise MathError("unexpected }")
        elif in_row and kind in SLOTS and top.items:
            stack.append(Call(1, slot=SLOTS[kind]))
        elif kind == "{":
            stack.append(Row(("}", "}")))
        elif kind == "operator" and value in FENCES:
            stack.append(Row((kind, FENCES[value]), fenced(value, FENCES[value])))
        elif kind == "command" and value in CALLS:
            stack.append(Call(*CALLS[value]))
        elif kind == "command" and value == "text":
            plain, at = literal(tokens, at)
            reduce(tag("mtext", text(plain)))
        else:
            reduce(leaf(kind, value))
    # What still waits at the end gets empty operands; a row that waits for its end has none.
    while len(stack) > 1:
        if isinstance(stack[-1], Row):
            raise MathError(f"a closing {stack[-1].close[1]} is missing")
        reduce(tag("mrow"))
    return stack[0].done()


def cut(source: str, at: str) -> list[str]:
    return [part for part in map(str.strip, source.split(at)) if part]


def rows_of(parts: list[str]) -> str:
    return "".join([tag("mtr", tag("mtd", body(part))) for part in parts])


#: Layouts of a source by what divides it: how its parts become MathML.
LEFT = "left"
BRACE = tag("mo", "{", fence="true", stretchy="true")
LAYOUTS: dict[str, Callable[[list[str]], str]] = {
    "\n": lambda parts: tag("mtable", rows_of(parts), columnalign=LEFT),
    "||": lambda parts: tag("mtable", tag("mtr", "".join([tag("mtd", cell(part)) for part in parts])), columnalign="left center left center left"),
    ";": lambda parts: tag("mrow", BRACE + tag("mtable", rows_of(parts), columnalign=LEFT)),
}


def cell(source: str) -> str:
    """A column's content: a system, or what is left of one without its dividers."""
    parts = cut(source, ";")
    return LAYOUTS[";"](parts) if len(parts) > 1 else body("".join(parts))


def laid_out(source: str, *dividers: str) -> str:
    """MathML of a source by the first divider that applies to it; one expression where none does."""
    for divider in dividers:
        parts = cut(source, divider)
        if len(parts) > 1 or (divider == "||" and divider in source):
            return LAYOUTS[divider](parts)
    return body(source)


def to_mathml(source: str | None, display: str = "inline") -> str:
    """MathML of a source: '||' makes columns, ';' a system, lines a table. Raises MathError on unbalanced groups."""
    content = laid_out(strip_dollars(source), *LAYOUTS)
    return tag("math", content, xmlns=NS, display="block" if display == "block" else "inline")


def repaired(source: str | None) -> str:
    """Drops closing brackets that nothing opened and adds those that are missing: braces first, then the rest inside out."""
    out, braces, opened = [], 0, []
    for ch in (source or "").replace(r"\\text", r"\text"):
        if ch == "{":
            braces += 1
        elif ch in "([":
            opened.append(ch)
        elif ch == "}":
            if not braces:
                continue
            braces -= 1
        elif ch in ")]":
            if not opened or FENCES[opened[-1]] != ch:
                continue
            opened.pop()
        out.append(ch)
    return "".join(out) + "}" * braces + "".join(FENCES[c] for c in reversed(opened))


_BACK = {v: k for k, v in (OPERATORS | GREEK).items()}


def to_source(mathml: str | None) -> str:
    """The editor source of a MathML string; the inverse of to_mathml() up to spacing and redundant groups."""
    if not (mathml or "").strip():
        return ""

    def braces(node) -> str:
        return "{" + of(node) + "}"

    def of(node) -> str:
        name, kids, own = node.tag.split("}")[-1], list(node), (node.text or "").strip()
        if name in ("mi", "mo", "mn"):
            return f"\\{_BACK[own]} " if own in _BACK and own not in FENCES else (f"\\{own} " if own in FUNCTIONS else own)
        if name == "mtext":
            return f"\\text{{{own}}}"
        if name == "mfrac":
            return "\\frac" + "".join(map(braces, kids))
        if name == "msqrt":
            return "\\sqrt{" + "".join(map(of, kids)) + "}"
        if name in ("msub", "msup", "msubsup"):
            marks = {"msub": "_", "msup": "^", "msubsup": "_^"}[name]
            return of(kids[0]) + "".join(m + braces(k) for m, k in zip(marks, kids[1:], strict=False))
        if name == "mstyle":
            command = {v: k for k, v in STYLES.items()}.get(node.get("mathvariant", ""), "mathrm")
            return f"\\{command}{{" + "".join(map(of, kids)) + "}"
        if name == "mtable":
            sep = " ; " if node.get("columnalign") == "left" and len(kids) > 1 else "\n"
            return sep.join(" || ".join(of(td) for td in tr) for tr in kids)
        if name == "mrow" and kids and kids[0].get("fence") == "true":
            return "".join(map(of, kids[1:]))
        return "".join(map(of, kids)) or own

    return of(ElementTree.fromstring(mathml)).strip()


def _parsed(sources: pd.Series) -> pd.DataFrame:
    def one(s):
        try:
            return True, to_mathml(s), None
        except MathError as e:
            return False, "", str(e)

    return pd.DataFrame([one(s) for s in sources], columns=["ok", "mathml", "error"])


def _repaired(sources: pd.Series) -> pd.Series:
    return sources.map(repaired)


def _source(mathml: pd.Series) -> pd.Series:
    return mathml.map(to_source)


def parse_math(source: Column) -> Column:
    """struct(ok, mathml, error) of a source; an unbalanced one is not ok and has the message."""
    return F.pandas_udf(_parsed, "ok boolean, mathml string, error string")(source)


def repair_brackets(source: Column) -> Column:
    return F.pandas_udf(_repaired, "string")(source)


def math_source(mathml: Column) -> Column:
    return F.pandas_udf(_source, "string")(mathml)
