"""Symbols, relations and comments of one source file: a lexer for strings and comments, and nesting over its tokens.

Java and C++ nest by braces, Python by indentation. What a string or a comment holds is no code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The states of each language, longest first: comments, strings that span lines, strings, words, line ends, other signs.
_WORD = r"(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)"
_REST = r"|(?P<line>\n)|(?P<space>[^\S\n]+)|(?P<sign>::|->|.)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"
_BLOCK = r"(?P<comment>/\*.*?(?:\*/|\Z)|//(?:\\\n|[^\n])*)"
LEXERS = {
    "java": re.compile(rf'{_BLOCK}|(?P<string>"""(?:\\.|.)*?(?:"""|\Z)|{_QUOTED})|{_WORD}{_REST}', re.DOTALL),
    "cpp": re.compile(rf'{_BLOCK}|(?P<string>(?:u8|[uUL])?R"(?P<raw>[^()\\\s]{{0,16}})\(.*?(?:\)(?P=raw)"|\Z)|{_QUOTED})|(?P<macro>(?<![^\n])[^\S\n]*\#(?:\\\n|[^\n])*)|{_WORD}{_REST}', re.DOTALL),
    "python": re.compile(rf"(?P<comment>\#[^\n]*)|(?P<string>(?i:[rbuft]{{0,2}})(?:\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'''(?:\\.|.)*?(?:'''|\Z)|{_QUOTED}))|(?P<join>\\\n)|{_WORD}{_REST}", re.DOTALL),
}
# The suffixes of files that are parsed, in lower case, and their languages.
SUFFIXES = {".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".py": "python"}
#: Words in front of a parenthesis that call nothing and name no method.
NO_CALL = frozenset("if for while switch catch return new def class super sizeof else do try synchronized throw elif except with assert not and or in is lambda yield await async alignof decltype static_assert noexcept throws case delete when operator".split())
CLASSES = frozenset("class interface enum struct record union".split())
ACCESS = frozenset("public private protected virtual".split())
#: Words that may stand between a method's parameters and its body.
AFTER_PARAMETERS = frozenset("const noexcept override final volatile throws throw mutable requires".split())


@dataclass
class Token:
    kind: str
    text: str
    line: int
    column: int


@dataclass
class Block:
    kind: str
    name: str
    start: int
    signature: str = ""
    bases: list[str] = field(default_factory=list)
    end: int = 0
    indent: int = 0
    parent: Block | None = None
    calls: list[str] = field(default_factory=list)


@dataclass
class Source:
    """What one file holds: blocks of kinds Class and Method in order, comments as (line, text), and whether its nesting closes."""

    blocks: list[Block]
    comments: list[tuple[int, str]]
    whole: bool


def language_of(path: str) -> str | None:
    return next((lang for suffix, lang in SUFFIXES.items() if path.lower().endswith(suffix)), None)


def lex(content: str, language: str) -> tuple[list[Token], list[tuple[int, str]]]:
    """Tokens without comments and spaces (a string is one token), and the comments; lines from 1."""
    tokens, comments, line, begin = [], [], 1, 0
    for m in LEXERS[language].finditer(content):
        kind, text = m.lastgroup, m[0]
        kind = "string" if kind == "raw" else kind
        if kind == "comment":
            comments.append((line, text))
        elif kind not in ("space", "macro", "join"):
            tokens.append(Token(kind, text, line, m.start() - begin))
        if "\n" in text:
            line += text.count("\n")
            begin = m.start() + text.rindex("\n") + 1
    return tokens, comments


def _closing(tokens: list[Token], at: int) -> int:
    """The place of what closes the bracket at ``at``, or the end."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k].text in ("(", "[")) - (tokens[k].text in (")", "]"))
        if not depth:
            return k
    return len(tokens) - 1


def _text(tokens: list[Token]) -> str:
    """Tokens as text, with one space between words, after commas and around no other sign."""
    out = ""
    for t in tokens:
        wordy = out[-1:].isalnum() or out[-1:] in ("_", ">", "]", "&", "*")
        out += (" " if out and ((wordy and t.kind in ("word", "number")) or out[-1:] == "," or (t.text == "=" or out[-1:] == "=")) else "") + t.text
    return out


def _calls(tokens: list[Token]) -> list[tuple[int, str]]:
    """Places and names of what is called: the last word of a path in front of a parenthesis, made objects left out."""
    out = []
    for k in range(1, len(tokens)):
        if tokens[k].text != "(" or tokens[k - 1].kind != "word" or tokens[k - 1].text in NO_CALL:
            continue
        first = k - 1
        while first >= 2 and tokens[first - 1].text in (".", "::", "->") and tokens[first - 2].kind == "word":
            first -= 2
        if first and tokens[first - 1].text in ("new", "def", "class"):
            continue
        out.append((k - 1, tokens[k - 1].text))
    return out


def _braced_head(head: list[Token]) -> Block | None:
    """The class or method that the tokens in front of an opening brace declare, if they do."""
    top, k = [], 0
    while k < len(head):  # what stands in brackets is no part of the declaration but for the parameters
        if head[k].text in ("(", "["):
            end = _closing(head, k)
            top.append((k, end))
            k = end
        else:
            top.append((k, k))
        k += 1
    words = [(k, head[k].text) for k, end in top if k == end and head[k].kind == "word"]
    for place, w in words:
        if w in CLASSES and not (place and head[place - 1].text in ("<", ",", "@")):
            names = [(p, n) for p, n in words if p > place and n not in CLASSES and n not in ("final", "alignas")]
            if not names:
                return None
            bases, keep, depth = [], False, 0
            for p in range(names[0][0] + 1, len(head)):
                t = head[p]
                depth += t.text.count("<") - t.text.count(">") * (t.text != "->")
                if t.text in ("extends", "implements", ":", ","):
                    keep = (keep or t.text != ",") and depth == 0
                elif t.kind == "word" and keep and t.text not in ACCESS and depth == 0:
                    if head[p - 1].text in (".", "::"):
                        bases[-1] = t.text
                    elif head[p - 1].text in ("extends", "implements", ":", ",") or head[p - 1].text in ACCESS:
                        bases.append(t.text)
            return Block("Class", names[0][1], head[place].line, bases=bases)
    for n, (k, end) in enumerate(top):
        if k == end and head[k].text in ("=", "->", "return", "new", "."):
            return None
        if k < end and head[k].text == "(" and n and head[k - 1].kind == "word" and head[k - 1].text not in NO_CALL:
            if k >= 2 and head[k - 2].text in ("@", "."):
                continue  # an annotation, or a call
            after = [head[p].text for p, e in top[n + 1 :] if p == e]
            if k == 1 and not after and head[0].text.isupper():
                return None  # a macro
            if after and after[0] not in AFTER_PARAMETERS and after[0] not in ("->", ":", "&", "&&"):
                return None
            return Block("Method", head[k - 1].text, head[k - 1].line, signature=f"{head[k - 1].text}({_text(head[k + 1 : end])})")
    return None


def _braced(tokens: list[Token]) -> tuple[list[Block], bool]:
    blocks: list[Block] = []
    open_: list[Block] = []
    head: list[Token] = []
    depth, whole = 0, True

    def give(rest: list[Token]) -> None:
        holder = next((b for b in reversed(open_) if b.kind == "Method"), None)
        if holder:
            holder.calls += [name for _, name in _calls(rest)]

    for t in tokens:
        if t.kind == "line":
            continue
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "{":
            made = _braced_head(head)
            if made is None:
                give(head)
                made = Block("", "", t.line)
            made.parent = next((b for b in reversed(open_) if b.kind), None)
            open_.append(made)
            if made.kind:
                blocks.append(made)
            made.indent, depth, head = depth, 0, []
        elif t.text == "}":
            give(head)
            head = []
            if not open_:
                whole = False
                continue
            closed = open_.pop()
            closed.end, depth = t.line, closed.indent
        elif t.text == ";" and depth <= 0:
            give(head)
            head = []
        else:
            head.append(t)
    give(head)
    last = tokens[-1].line if tokens else 1
    for b in open_:
        b.end = last
    return blocks, whole and not open_


def _indented(tokens: list[Token]) -> tuple[list[Block], bool]:
    blocks: list[Block] = []
    open_: list[Block] = []
    own: list[Token] = []
    depth, whole = 0, True

    def logical(row: list[Token]) -> None:
        while open_ and row[0].column <= open_[-1].indent:
            open_.pop()
        for b in open_:
            b.end = row[-1].line
        k = 1 if row[0].text == "async" and len(row) > 1 else 0
        made = None
        if row[k].text in ("class", "def") and len(row) > k + 1 and row[k + 1].kind == "word":
            end = _closing(row, k + 2) if len(row) > k + 2 and row[k + 2].text == "(" else k + 2
            inner = row[k + 3 : end]
            made = Block("Class" if row[k].text == "class" else "Method", row[k + 1].text, row[k].line, end=row[-1].line, indent=row[0].column, parent=open_[-1] if open_ else None)
            if made.kind == "Method":
                made.signature = f"{made.name}({_text([t for t in inner if t.kind != 'line'])})"
            else:
                at = 0
                while at < len(inner):
                    stop, level = at, 0
                    while stop < len(inner) and (level or inner[stop].text != ","):
                        level += (inner[stop].text in "([") - (inner[stop].text in ")]")
                        stop += 1
                    part = inner[at:stop]
                    if part and part[0].kind == "word" and not any(t.text == "=" for t in part):
                        name, p = part[0].text, 1
                        while p + 1 < len(part) and part[p].text == ".":
                            name, p = part[p + 1].text, p + 2
                        made.bases.append(name)
                    at = stop + 1
            blocks.append(made)
        if made is None or row[-1].text != ":":
            holder = next((b for b in reversed(open_) if b.kind == "Method"), None) if made is None else made if made.kind == "Method" else None
            rest = row if made is None else row[_closing(row, k + 2) + 1 :] if len(row) > k + 2 and row[k + 2].text == "(" else row[k + 2 :]
            if holder:
                holder.calls += [name for _, name in _calls(rest)]
        if made is not None:
            open_.append(made)

    for t in tokens:
        depth += (t.kind == "sign" and t.text in "([{") - (t.kind == "sign" and t.text in ")]}")
        if t.kind == "line" and depth <= 0:
            whole = whole and depth == 0
            depth = 0
            if own:
                logical(own)
            own = []
        elif t.kind != "line":
            own.append(t)
    if own:
        logical(own)
    return blocks, whole and depth == 0


def parse(content: str, language: str) -> Source:
    tokens, comments = lex(content, language)
    blocks, whole = (_indented if language == "python" else _braced)(tokens)
    return Source(blocks, comments, whole)


def relations(source: Source, path: str) -> list[tuple[str, str, str, str]]:
    """(type, source, target, path) by name: where blocks are defined, what classes inherit, whose members methods are, what they call."""
    out = []
    for b in source.blocks:
        out.append(("DEFINED_IN", b.name, path, path))
        out += [("INHERITS", b.name, base, path) for base in b.bases]
        if b.kind == "Method":
            holder = b.parent
            while holder is not None and holder.kind != "Class":
                holder = holder.parent
            if holder is not None:
                out.append(("MEMBER_OF", b.name, holder.name, path))
            out += [("CALLS", b.name, c, path) for c in sorted(set(b.calls))]
    return list(dict.fromkeys(out))
