"""From grok or Python-style regex text to one expression for the JVM regex engine.

Done once per pattern on the driver.  The JVM engine has no underscore in group names, so
named groups become plain ones and are addressed by number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from logloom.functions.grok_library import BUILTIN_PATTERNS

MAX_NESTING = 10
COMPONENT_NAME = re.compile(r"^[A-Z][A-Z0-9_]*$")
_REFERENCE = re.compile(r"%\{(?P<component>[A-Z0-9_]+)(?::(?P<field>[a-zA-Z0-9_]+))?(?::[a-z]+)?\}")

# Character classes with the meaning they have for Unicode text.
_CLASSES = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r"\s\x1c-\x1f"}


class PatternError(ValueError):
    """Raised on the driver, before any job starts."""


@dataclass(frozen=True)
class CompiledPattern:
    python_regex: str
    java_regex: str
    fields: tuple[tuple[str, int], ...]
    # Fields whose absence cannot be told from an empty match by the JVM functions.
    ambiguous: frozenset[str] = frozenset()
    # Fields that always take part, so an empty string is a real empty match.
    always_present: frozenset[str] = frozenset()
    # Text every match holds, '' when none is known: a cheap test before the regex runs.
    required_text: str = ""

    @property
    def field_names(self) -> list[str]:
        return [name for name, _ in self.fields]

    @property
    def anchored(self) -> str:
        return f"(?dU)^(?:{self.java_regex})"

    @property
    def spanning(self) -> str:
        """Same match and groups as ``anchored``, stretched over the rest of the text."""
        return f"(?dU)^(?:{self.java_regex})(?s:.*)$"

    @property
    def unanchored(self) -> str:
        return f"(?dU){self.java_regex}"


def expand_grok(text: str, components: dict[str, str] | None = None, depth: int = MAX_NESTING) -> str:
    """Replace %{NAME}, %{NAME:field} and %{NAME:field:type} until none is left."""
    known = BUILTIN_PATTERNS if components is None else components
    if depth <= 0:
        raise PatternError("pattern components are nested too deeply (circular reference?)")
    out, at = [], 0
    for reference in _REFERENCE.finditer(text):
        name, captured_as = reference["component"], reference["field"]
        if name not in known:
            raise PatternError(f"unknown pattern component: {name}")
        body = known[name]
        if "%{" in body:
            body = expand_grok(body, known, depth - 1)
        opening = f"(?P<{captured_as}>" if captured_as else "(?:"
        out += [text[at : reference.start()], opening, body, ")"]
        at = reference.end()
    out.append(text[at:])
    return "".join(out)


def named_groups_to_python(text: str) -> str:
    """Accept (?<name>…) and (?'name'…) besides (?P<name>…)."""
    return re.sub(r"\(\?(?:<([A-Za-z_]\w*)>|'([A-Za-z_]\w*)')", lambda m: f"(?P<{m[1] or m[2]}>", text)


@dataclass
class _Group:
    start: int
    number: int | None = None
    parent: "_Group | None" = None
    has_choice: bool = False
    skippable: bool = False
    looks_around: bool = False
    body: str = ""


@dataclass
class _Translation:
    java: list[str] = field(default_factory=list)
    groups: dict[int, _Group] = field(default_factory=dict)
    literals: list[tuple[_Group, str]] = field(default_factory=list)
    flagged: bool = False


def _translate(source: str, index_of: dict[str, int]) -> _Translation:
    """Rewrite the constructs whose spelling differs between the two regex dialects."""
    result = _Translation()
    java = result.java
    current = _Group(start=0)
    count, i, in_class, run = 0, 0, False, ""

    def end_run() -> None:
        nonlocal run
        if run:
            result.literals.append((current, run))
        run = ""

    def literal(text: str, following: str) -> None:
        """Extend the run of literal text unless a quantifier makes it optional."""
        nonlocal run
        if following[:1] in ("?", "*", "{"):
            end_run()
        else:
            run += text
            if following[:1] == "+":
                end_run()

    while i < len(source):
        char, pair = source[i], source[i : i + 2]
        if char == "\\":
            code = source[i + 1]
            if not in_class and not code.isalnum():
                literal(code, source[i + 2 : i + 3])
            else:
                end_run()
            if code in _CLASSES:
                java.append(_CLASSES[code] if in_class else f"[{_CLASSES[code]}]")
            elif code in "WDS":
                java.append(f"[^{_CLASSES[code.lower()]}]")
            elif code == "Z":
                java.append(r"\z")
            elif code == "U":
                java.append(rf"\x{{{source[i + 2 : i + 10]}}}")
                i += 8
            else:
                java.append(pair)
            i += 2
            continue
        if in_class:
            # The JVM reads '[' and '&&' inside a class as set operations.
            if char == "]" and i > class_start:
                in_class = False
                java.append(char)
            else:
                java.append("\\" + char if char in "[&" or (char == "]" and i == class_start) else char)
            i += 1
            continue
        if char not in "[(){|^$.?*+":
            literal(char, source[i + 1 : i + 2])
        else:
            end_run()
        if char == "[":
            in_class = True
            negated = source[i + 1 : i + 2] == "^"
            class_start = i + 1 + negated
            java.append("[^" if negated else "[")
            i += 1 + negated
        elif char == "(":
            if source.startswith("(?#", i):
                i = source.index(")", i) + 1
                continue
            opened = _Group(start=i, parent=current)
            named = re.match(r"\(\?P<(\w+)>", source[i:])
            back = re.match(r"\(\?P=(\w+)\)", source[i:])
            if back:
                java.append(f"(?:\\{index_of[back[1]]})")
                i += back.end()
                continue
            if re.match(r"\(\?\(", source[i:]):
                raise PatternError("conditional groups are not supported")
            opened.looks_around = bool(re.match(r"\(\?<?[=!]", source[i:]))
            result.flagged |= bool(re.match(r"\(\?[aiLmsux-]", source[i:]))
            if named or source[i + 1 : i + 2] != "?":
                count += 1
                opened.number = count
                result.groups[count] = opened
                java.append("(")
                i += named.end() if named else 1
            else:
                prefix = re.match(r"\(\?(?:<?[=!]|[:>])", source[i:])
                java.append(prefix[0] if prefix else "(")
                i += prefix.end() if prefix else 1
            opened.start = i
            current = opened
        elif char == ")":
            current.body = source[current.start : i]
            java.append(char)
            i += 1
            if re.match(r"[?*]|\{0?,|\{0\}", source[i:]):
                current.skippable = True
            current = current.parent or current
        elif char == "|":
            current.has_choice = True
            java.append(char)
            i += 1
        elif char == "{":
            counted = re.match(r"\{(\d*)(,?)(\d*)\}", source[i:])
            if counted and (counted[1] or counted[3]):
                java.append("{" + (counted[1] or "0") + counted[2] + counted[3] + "}")
                i += counted.end()
            else:
                java.append("\\{")
                i += 1
        else:
            java.append(char)
            i += 1
    end_run()
    return result


def _required_text(translation: _Translation) -> str:
    """Longest literal run outside choices, optional groups and look-arounds."""

    def certain(group: _Group | None) -> bool:
        while group is not None:
            if group.skippable or group.has_choice or group.looks_around:
                return False
            group = group.parent
        return True

    if translation.flagged:
        return ""
    return max((text for group, text in translation.literals if certain(group)), key=len, default="")


def _may_be_skipped(group: _Group) -> bool:
    node: _Group | None = group
    while node is not None:
        if node.skippable or (node is not group and node.has_choice):
            return True
        node = node.parent
    return False


def _may_be_empty(body: str) -> bool:
    try:
        return re.compile(named_groups_to_python(body)).fullmatch("") is not None
    except re.error:
        return True


def compile_pattern(
    text: str, kind: str = "grok", components: dict[str, str] | None = None
) -> CompiledPattern:
    """Compile grok or regex text; every error surfaces here, on the driver."""
    if kind not in ("grok", "regex"):
        raise PatternError(f"unknown pattern kind: {kind}")
    expanded = expand_grok(text, components) if kind == "grok" else text
    source = named_groups_to_python(expanded)
    try:
        checked = re.compile(source)
    except re.error as problem:
        raise PatternError(f"invalid regular expression: {problem}") from problem
    translation = _translate(source, checked.groupindex)
    fields = tuple(sorted(checked.groupindex.items(), key=lambda item: item[1]))
    ambiguous, present = set(), set()
    for name, number in fields:
        group = translation.groups[number]
        if not _may_be_skipped(group):
            present.add(name)
        elif _may_be_empty(group.body):
            ambiguous.add(name)
    return CompiledPattern(
        python_regex=source,
        java_regex="".join(translation.java),
        fields=fields,
        ambiguous=frozenset(ambiguous),
        always_present=frozenset(present),
        required_text=_required_text(translation),
    )
