"""Regular expressions of rules and probes: the linear-time dialect of their files, written for Spark's regex functions."""

from __future__ import annotations

import functools
import re

# The ASCII class names of the dialect.
CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\t\x20", "cntrl": r"\p{Cntrl}", "digit": "0-9",
    "graph": r"\x21-\x7E", "lower": "a-z", "print": r"\x20-\x7E", "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z",
    "word": r"0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_SIMPLE_ESCAPES = set("aftnrvdDsSwWbBAzxQE")
_REPEAT = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")


class _Translation:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.out = pattern, 0, []
        self.groups, self.names, self.depth = 0, {}, 0
        self.multiline = [False]

    def fail(self, what: str):
        raise ValueError(f"{what} in regular expression {self.pattern!r}")

    def rest(self) -> str:
        return self.pattern[self.at:]

    def escape(self, inside: bool) -> str:
        c = self.pattern[self.at + 1:self.at + 2]
        if not c:
            self.fail("trailing backslash")
        if c in "pP":
            m = re.match(r"\\[pP](?:\{(\^?)(\w+)\}|(\w))", self.rest())
            if not m:
                self.fail("bad character property")
            self.at += m.end()
            name = m[2] or m[3]
            letter = ("P" if c == "p" else "p") if m[1] else c
            return f"\\{letter}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if c.isalnum() and c not in _SIMPLE_ESCAPES and not (c in "01234567" and re.match(r"\\(?:0|[1-7][0-7])", self.rest())):
            self.fail(f"escape \\{c}")
        if c in "01234567":
            m = re.match(r"\\([0-7]{1,3})", self.rest())
            self.at += m.end()
            return f"\\x{{{int(m[1], 8):x}}}"
        if c == "x":
            m = re.match(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))", self.rest())
            if not m:
                self.fail("bad hexadecimal escape")
            self.at += m.end()
            return f"\\x{{{m[1] or m[2]}}}"
        self.at += 2
        if c == "v":
            return r"\x0B"
        if inside and c in "bBAzQE":
            self.fail(f"escape \\{c} in a class")
        return "\\" + c if c.isalnum() else re.escape(c) if ord(c) < 128 else c

    def quoted(self) -> str:
        end = self.pattern.find(r"\E", self.at)
        text = self.pattern[self.at + 2:end if end >= 0 else len(self.pattern)]
        self.at = end + 2 if end >= 0 else len(self.pattern)
        return "".join(re.escape(c) if ord(c) < 128 else c for c in text)

    def char_class(self) -> str:
        out = ["["]
        self.at += 1
        if self.rest().startswith("^"):
            out.append("^")
            self.at += 1
        first = True
        while True:
            c = self.pattern[self.at:self.at + 1]
            if not c:
                self.fail("missing ]")
            if c == "]" and not first:
                self.at += 1
                return "".join(out) + "]"
            first = False
            m = re.match(r"\[:(\^?)(\w+):\]", self.rest())
            if m:
                if m[2] not in CLASSES:
                    self.fail(f"unknown class [:{m[2]}:]")
                out.append(f"[^{CLASSES[m[2]]}]" if m[1] else CLASSES[m[2]])
                self.at += m.end()
            elif c == "\\":
                out.append(self.escape(True))
            else:
                out.append("\\" + c if c in "[&]^" else c)
                self.at += 1

    def group(self):
        m = re.match(r"\(\?(?:P?<(\w+)>|([imsU]*(?:-[imsU]+)?)([:)]))", self.rest())
        if self.rest().startswith("(?") and not m:
            self.fail("look-around or another group this dialect lacks")
        if not m or m[1]:
            self.groups += 1
            if m:
                if m[1] in self.names:
                    self.fail(f"duplicate group {m[1]}")
                self.names[m[1]] = self.groups
            self.out.append("(")
            self.at += m.end() if m else 1
            self.multiline.append(self.multiline[-1])
            return
        on, _, off = m[2].partition("-")
        if "U" in m[2]:
            self.fail("flag U")
        lines = "m" in on or (self.multiline[-1] and "m" not in off)
        self.out.append(f"(?{on}{'d' if 'm' in on else ''}{'-' + off if off else ''}{m[3]}")
        self.at += m.end()
        if m[3] == ":":
            self.multiline.append(lines)
        else:
            self.multiline[-1] = lines

    def run(self) -> str:
        repeated = True  # nothing to repeat yet
        while self.at < len(self.pattern):
            c = self.pattern[self.at]
            m = _REPEAT.match(self.pattern, self.at)
            if m:
                if repeated:
                    self.fail("repetition of nothing or of a repetition")
                self.at = m.end()
                lazy = self.rest().startswith("?")
                self.at += lazy
                self.out.append(m[0] + "?" * lazy)
                repeated = True
                continue
            repeated = c in "(|"
            if c == "\\":
                self.out.append(self.quoted() if self.rest().startswith(r"\Q") else self.escape(False))
            elif c == "[":
                self.out.append(self.char_class())
            elif c == "(":
                self.group()
            elif c == ")":
                if len(self.multiline) == 1:
                    self.fail("unexpected )")
                self.multiline.pop()
                self.out.append(")")
                self.at += 1
            elif c == "$":
                self.out.append("$" if self.multiline[-1] else r"\z")
                self.at += 1
            else:
                self.out.append("\\" + c if c in "{}" else c)
                self.at += 1
        if len(self.multiline) != 1:
            self.fail("missing )")
        return "".join(self.out)


@functools.lru_cache(maxsize=4096)
def java_pattern(pattern: str) -> tuple[str, int, dict[str, int]]:
    """The pattern for Spark, its number of groups and the numbers of the named ones.

    What the dialect refuses is refused here too: look-around, back references, atomic groups, possessive and nested
    repetitions. Dots match line ends only under the flag s.
    """
    translation = _Translation(pattern)
    text = translation.run()
    return text, translation.groups, translation.names
