"""Blanks comments and strings, keeping every line and column where it was."""

from __future__ import annotations

import functools
import re

_C = "javascript typescript java c cpp csharp go kotlin scala swift dart rust php zig protobuf razor"
LINE = {**dict.fromkeys(_C.split(), ["//"]), **dict.fromkeys("python ruby shell elixir julia r nim powershell yaml toml graphql".split(), ["#"]), "php": ["//", "#"], "lua": ["--"], "sql": ["--"], "erlang": ["%"], "clojure": [";"], "fsharp": ["//"], "hcl": ["#", "//"], "terraform": ["#", "//"]}
BLOCK = {**dict.fromkeys(_C.split(), ("/*", "*/")), **dict.fromkeys("css scss less sql hcl terraform".split(), ("/*", "*/")), "lua": ("--[[", "]]"), "julia": ("#=", "=#"), "fsharp": ("(*", "*)"), "html": ("<!--", "-->"), "vue": ("<!--", "-->"), "svelte": ("<!--", "-->"), "powershell": ("<#", "#>")}
NESTED = {"rust", "swift", "kotlin", "scala", "dart", "julia"}
_PLAIN = r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_BACK = r"`(?:\\.|[^`\\])*`"
_TRIPLE = r'"""[\s\S]*?"""'
STRINGS = {
    "go": [_BACK, _PLAIN, r"'(?:\\.|[^'\\\n])+'"], **dict.fromkeys(("javascript", "typescript"), [_BACK, _PLAIN, _SINGLE]), "python": [_TRIPLE, r"'''[\s\S]*?'''", _PLAIN, _SINGLE],
    "rust": [r'r#*"[\s\S]*?"#*', _PLAIN, r"'(?:\\.[^']*|[^'\\\n])'"], **dict.fromkeys(("java", "kotlin", "scala"), [_TRIPLE, _PLAIN, r"'(?:\\.[^'\n]*|[^'\\\n])'"]), "swift": [r'#"[\s\S]*?"#', _TRIPLE, _PLAIN],
    "csharp": [_TRIPLE, r'@"(?:""|[^"])*"', _PLAIN, r"'(?:\\.[^'\n]*|[^'\\\n])'"], "razor": [r'@"(?:""|[^"])*"', _PLAIN], **dict.fromkeys(("c", "cpp"), [r'R"(\w*)\([\s\S]*?\)\1"', _PLAIN, r"'(?:\\.[^'\n]*|[^'\\\n])'"]),
    "dart": [_TRIPLE, r"'''[\s\S]*?'''", _PLAIN, _SINGLE], "elixir": [_TRIPLE, r"'''[\s\S]*?'''", r"~[sS]\([^)]*\)", _PLAIN, _SINGLE], "julia": [_TRIPLE, _PLAIN], "lua": [r"\[\[[\s\S]*?\]\]", _PLAIN, _SINGLE],
    "ruby": [r"<<[~-]?(['\"]?)(\w+)\1[^\n]*\n[\s\S]*?^\s*\2$", _PLAIN, _SINGLE], "shell": [_PLAIN, r"'[^']*'"], "php": [r"<<<['\"]?(\w+)['\"]?\n[\s\S]*?^\s*\1;?", _PLAIN, _SINGLE], "zig": [r"\\\\[^\n]*", _PLAIN],
}
EMBED = {"ruby": [r"^=begin[\s\S]*?^=end"], "python": []}


@functools.cache
def _scanner(lang: str) -> re.Pattern | None:
    parts = []
    for form in EMBED.get(lang, []):
        parts.append(f"(?P<e{len(parts)}>{form})")
    if lang in BLOCK:
        a, b = map(re.escape, BLOCK[lang])
        parts.append(f"(?P<open>{a})" if lang in NESTED else rf"(?P<block>{a}[\s\S]*?(?:{b}|\Z))")
    if lang in LINE:
        parts.append("(?P<line>(?:" + "|".join(map(re.escape, LINE[lang])) + r")[^\n]*)")
    for i, form in enumerate(STRINGS.get(lang, [_PLAIN] if lang in LINE else [])):
        # groups inside a form are renamed, so that back references stay its own
        names = iter(range(9))
        renamed = re.sub(r"(?<!\\)\((?!\?)", lambda _, i=i, names=names: f"(?P<s{i}_{next(names)}>", form)
        renamed = re.sub(r"\\([1-9])", lambda m, i=i: f"(?P=s{i}_{int(m[1]) - 1})", renamed)
        parts.append(f"(?P<str{i}>{renamed})")
    return re.compile("|".join(parts), re.M) if parts else None


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


@functools.lru_cache(2)
def mask(text: str, lang: str, keep_strings: bool = False) -> str:
    """The text with comments, and strings unless they are kept, as blanks. One file is asked for its symbols and calls in turn."""
    scan = _scanner(lang)
    if scan is None:
        return text
    out, at = [], 0
    while m := scan.search(text, at):
        if m.end() == m.start():
            at = m.end() + 1
            out.append(text[m.start() : at])
            continue
        out.append(text[at : m.start()])
        end = m.end()
        if m.lastgroup == "open":
            a, b = BLOCK[lang]
            depth = 1
            for n in re.compile(f"{re.escape(a)}|{re.escape(b)}").finditer(text, m.end()):
                depth += 1 if n.group() == a else -1
                end = n.end()
                if not depth:
                    break
            else:
                end = len(text)
            out.append(_blank(text[m.start() : end]))
        elif m.lastgroup and m.lastgroup.startswith("s") and keep_strings:
            out.append(m.group())
        else:
            out.append(_blank(m.group()))
        at = end
    return "".join([*out, text[at:]])


def comments(text: str, lang: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of every comment outside strings; adjoining line comments are one."""
    scan = _scanner(lang)
    out: list[tuple[int, int, str]] = []
    if scan is None:
        return out
    for m in scan.finditer(text):
        kind = m.lastgroup or ""
        if kind.startswith("s"):
            continue
        body = m.group()
        if kind == "open":
            end = text.find(BLOCK[lang][1], m.end())
            body = text[m.start() : end + len(BLOCK[lang][1]) if end >= 0 else len(text)]
        first = text.count("\n", 0, m.start()) + 1
        last = first + body.count("\n")
        own_line = not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
        if kind == "line" and out and own_line and out[-1][1] == first - 1 and out[-1][2].startswith("\0"):
            out[-1] = (out[-1][0], last, out[-1][2] + "\n" + body)
        else:
            out.append((first, last, ("\0" if kind == "line" and own_line else "") + body))
    return [(a, b, t.lstrip("\0")) for a, b, t in out]
