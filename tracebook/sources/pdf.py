"""Text of PDF files: objects, page tree, content streams and character maps.

Covers what a text layer needs: plain and Flate streams, object streams, the
text operators, and ToUnicode maps; fonts without a map are read as Latin.
Pages come in the order of the page tree. Nothing is rendered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

SPACE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")


class Encrypted(Exception):
    """The file needs a password."""


class Name(str):
    """A name such as /Type, without the slash."""


class Operator(str):
    """A bare word of a content stream."""


@dataclass(frozen=True)
class Reference:
    number: int


class Scanner:
    """Values of PDF syntax from a place on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        data = self.data
        while self.at < len(data):
            if data[self.at] in SPACE:
                self.at += 1
            elif data[self.at] == 37:  # a comment
                while self.at < len(data) and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self):
        """The next value; None at the end, an Operator for a closing bracket."""
        self._skip()
        data = self.data
        if self.at >= len(data):
            return None
        c = data[self.at : self.at + 1]
        if data[self.at : self.at + 2] in (b"<<", b">>"):
            self.at += 2
            return self._dictionary() if c == b"<" else Operator(">>")
        if c in b"[]{})":
            self.at += 1
            return self._array() if c == b"[" else Operator(c.decode())
        if c == b"(":
            return self._string()
        if c == b"<":
            end = data.find(b">", self.at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        word = self._word()
        if c == b"/":
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), word[1:].decode("latin-1")))
        if NUMBER.match(word):
            return self._number_or_reference(word)
        return {b"true": True, b"false": False}.get(word, Operator(word.decode("latin-1")))

    def _word(self) -> bytes:
        begin = self.at
        self.at += 1
        while self.at < len(self.data) and self.data[self.at] not in SPACE and self.data[self.at] not in DELIMITERS:
            self.at += 1
        return self.data[begin : self.at]

    def _number_or_reference(self, word: bytes):
        m = re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(self.data, self.at)
        if m and word.isdigit():
            self.at = m.end()
            return Reference(int(word))
        return float(word) if b"." in word else int(word)

    def _array(self) -> list:
        out = []
        while (v := self.value()) is not None and v != Operator("]"):
            out.append(v)
        return out

    def _dictionary(self) -> dict:
        out = {}
        while isinstance(key := self.value(), Name):
            out[str(key)] = self.value()
        return out

    def _string(self) -> bytes:
        out, depth, data = bytearray(), 1, self.data
        self.at += 1
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 92 and self.at < len(data):
                octal = re.compile(rb"[0-7]{1,3}").match(data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                elif data[self.at] in b"\r\n":  # a line continued
                    self.at += 2 if data[self.at : self.at + 2] == b"\r\n" else 1
                else:
                    out.append(ESCAPES.get(data[self.at], data[self.at]))
                    self.at += 1
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                break
            out.append(c)
        return bytes(out)


class File:
    """The objects of a file, by number; of several the last counts."""

    def __init__(self, data: bytes):
        self.data = data
        self.places = {int(m[1]): m.end() for m in re.finditer(rb"(?<!\d)(\d{1,9})\s+\d{1,5}\s+obj\b", data)}
        self.packed: dict[int, object] = {}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", data):
            raise Encrypted
        for number in list(self.places):
            head = self.get(Reference(number))
            if isinstance(head, dict) and head.get("Type") == "ObjStm":
                self._unpack(number, head)

    def _unpack(self, number: int, head: dict) -> None:
        body, n = self.stream(Reference(number)), self.get(head.get("N"))
        index = Scanner(body)
        pairs = [(index.value(), index.value()) for _ in range(int(n or 0))]
        for at, offset in pairs:
            if isinstance(at, int) and at not in self.places:
                self.packed[at] = Scanner(body, int(self.get(head["First"])) + offset).value()

    def get(self, value):
        """The value, or what it refers to."""
        for _ in range(20):
            if not isinstance(value, Reference):
                return value
            if value.number in self.places:
                value = Scanner(self.data, self.places[value.number]).value()
            else:
                value = self.packed.get(value.number)
        return None

    def stream(self, reference) -> bytes:
        """The decoded bytes of a stream."""
        if not isinstance(reference, Reference) or reference.number not in self.places:
            return b""
        scan = Scanner(self.data, self.places[reference.number])
        head = scan.value()
        begin = re.compile(rb"\s*stream\r?\n?").match(self.data, scan.at)
        if not isinstance(head, dict) or not begin:
            return b""
        size = self.get(head.get("Length"))
        end = begin.end() + size if isinstance(size, int) else -1
        if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
            end = self.data.find(b"endstream", begin.end())
        body = self.data[begin.end() : end]
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {f}")
            body = zlib.decompressobj().decompress(body)
        return body

    def pages(self) -> Iterator[dict]:
        """The pages in the order of the tree, with what they inherit."""
        roots = [v for v in map(self.get, map(Reference, sorted({*self.places, *self.packed}))) if isinstance(v, dict) and v.get("Type") == "Catalog"]
        stack: list[tuple[object, dict]] = [(roots[-1].get("Pages"), {})] if roots else []
        seen: set[Reference] = set()
        while stack:
            node, above = stack.pop()
            if isinstance(node, Reference):
                if node in seen:
                    continue
                seen.add(node)
            node = self.get(node)
            if not isinstance(node, dict):
                continue
            whole = above | {k: v for k, v in node.items() if k == "Resources"}
            if "Kids" in node:
                stack += [(k, whole) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                yield node | whole


def character_map(body: bytes) -> tuple[dict[bytes, str], set[int]]:
    """A ToUnicode map: code to text, and the lengths that codes have."""
    out: dict[bytes, str] = {}
    scan, held = Scanner(body), []
    text = lambda b: b.decode("utf-16-be", "replace")
    while (v := scan.value()) is not None:
        if not isinstance(v, Operator):
            held.append(v)
            continue
        if v == "endbfchar":
            out.update((a, text(b)) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes))
        elif v == "endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3]):
                first = int.from_bytes(low, "big")
                for i in range(min(int.from_bytes(high, "big") - first, 65535) + 1):
                    code = (first + i).to_bytes(len(low), "big")
                    if isinstance(to, list):
                        out[code] = text(to[i]) if i < len(to) else ""
                    elif to:
                        out[code] = text(to[:-2] + ((int.from_bytes(to[-2:], "big") + i) & 0xFFFF).to_bytes(2, "big"))
        held = []
    return out, {len(k) for k in out}


class Writer:
    """Puts the shown strings together: a move to another line begins one, a
    wide gap within a line is a space."""

    def __init__(self, fonts: dict[str, tuple[dict[bytes, str], set[int]]]):
        self.fonts, self.font = fonts, ({}, set())
        self.out: list[str] = []
        self.y, self.leading = 0.0, 0.0

    def line(self) -> None:
        if self.out and self.out[-1] != "\n":
            self.out.append("\n")

    def decoded(self, raw: bytes) -> str:
        known, sizes = self.font
        if not known:
            return raw.decode("cp1252", "replace")
        out, at = [], 0
        while at < len(raw):
            size = next((n for n in sorted(sizes, reverse=True) if raw[at : at + n] in known), max(sizes))
            out.append(known.get(raw[at : at + size], ""))
            at += size
        return "".join(out)

    def show(self, parts: list) -> None:
        for p in parts:
            if isinstance(p, bytes):
                self.out.append(self.decoded(p))
            elif isinstance(p, int | float) and p < -200 and self.out and not self.out[-1].endswith((" ", "\n")):
                self.out.append(" ")

    def run(self, op: str, args: list) -> None:
        number = [a for a in args if isinstance(a, int | float)]
        if op == "Tf" and args and isinstance(args[0], Name):
            self.font = self.fonts.get(str(args[0]), ({}, set()))
        elif op in ("Td", "TD") and len(number) == 2:
            if number[1]:
                self.line()
            elif self.out and not self.out[-1].endswith((" ", "\n")):
                self.out.append(" ")
        elif op == "Tm" and len(number) == 6:
            if number[5] != self.y:
                self.line()
            self.y = number[5]
        elif op in ("T*", "BT"):
            self.line()
        elif op in ("Tj", "TJ"):
            self.show(args[-1] if args and isinstance(args[-1], list) else args)
        elif op in ("'", '"'):
            self.line()
            self.show(args[-1:])


def page_text(file: File, page: dict) -> str:
    fonts = {}
    resources = file.get(page.get("Resources")) or {}
    for name, ref in (file.get(resources.get("Font")) or {}).items():
        font = file.get(ref) or {}
        fonts[name] = character_map(file.stream(font["ToUnicode"])) if "ToUnicode" in font else ({}, set())
    contents = page.get("Contents")
    parts = contents if isinstance(contents, list) else file.get(contents) if isinstance(file.get(contents), list) else [contents]
    scan, writer, args = Scanner(b"\n".join(file.stream(p) for p in parts)), Writer(fonts), []
    while (v := scan.value()) is not None:
        if isinstance(v, Operator):
            if v == "ID":  # an inline image
                end = re.compile(rb"\sEI(?=\s|$)").search(scan.data, scan.at)
                scan.at = end.end() if end else len(scan.data)
            writer.run(v, args)
            args = []
        else:
            args.append(v)
    return "".join(writer.out)


def pages_of(data: bytes) -> Iterator[tuple[str, str | None]]:
    """Text and warning of each page. A page that fails is empty."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF")
    file = File(data)
    for page in file.pages():
        try:
            yield page_text(file, page), None
        except Exception as e:  # one bad page does not take the others with it
            yield "", f"{type(e).__name__}: {e}"[:200]
