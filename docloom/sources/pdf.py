"""Text of PDF files with the standard library: page tree, Flate streams, simple fonts and ToUnicode maps."""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
STREAM = re.compile(rb"(.*?)stream\r?\n(.*?)\r?\n?endstream", re.S)
REF = rb"(\d+)\s+\d+\s+R"
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"][A-Za-z0-9*'\"]*|T\*", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
#: A gap in a line of text, in thousandths of a character's size, from which on it is a space.
GAP = -200
#: Unpacked bytes of one file at most; larger ones are errors.
MAX_UNPACKED = 256 << 20


class _File:
    def __init__(self, data: bytes):
        if b"/Encrypt" in data:
            raise ValueError("encrypted")
        self.left = MAX_UNPACKED
        self.objects = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:2000]:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        """Objects of an object stream; those written plainly win."""
        head, data = self.stream(body)
        first = re.search(rb"/First\s+(\d+)", head)
        if not first:
            return
        at = int(first[1])
        numbers = [int(x) for x in data[:at].split()]
        pairs = list(zip(numbers[::2], numbers[1::2], strict=False))
        for k, (number, begin) in enumerate(pairs):
            end = pairs[k + 1][1] if k + 1 < len(pairs) else len(data) - at
            self.objects.setdefault(number, data[at + begin : at + end])

    def stream(self, body: bytes) -> tuple[bytes, bytes]:
        m = STREAM.match(body)
        if not m:
            return body, b""
        head, raw = m[1], m[2]
        if b"/FlateDecode" in head:
            try:
                raw = zlib.decompressobj().decompress(raw, max(1, self.left))
            except zlib.error as e:
                raise ValueError("broken stream") from e
            self.left -= len(raw)
            if self.left <= 0:
                raise ValueError("too large when unpacked")
        elif b"/Filter" in head:
            raw = b""
        return head, raw

    def value(self, body: bytes, key: bytes) -> bytes:
        """What follows ``key`` in an object: the object it refers to, or its own text from there."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(?:" + REF + rb"|(.))", body, re.S)
        if not m:
            return b""
        return self.objects.get(int(m[1]), b"") if m[1] else body[m.start(2) :]

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree."""
        root = next((o for o in self.objects.values() if re.search(rb"/Type\s*/Catalog", o)), b"")
        out, seen, rest = [], set(), [self.value(root, b"Pages")]
        while rest:
            own = rest.pop()
            kids = re.search(rb"/Kids\s*\[(.*?)\]", own, re.S)
            if kids:
                numbers = [int(x) for x in re.findall(REF, kids[1])]
                rest += [self.objects.get(n, b"") for n in reversed(numbers) if not (n in seen or seen.add(n))]
            elif own:
                out.append(own)
        return out or [o for o in self.objects.values() if re.search(rb"/Type\s*/Page(?![a-zA-Z])", o)]

    def fonts(self, page: bytes) -> dict[bytes, dict]:
        """The character map of each font of a page that has one."""
        found = {}
        fonts = self.value(self.value(page, b"Resources") or page, b"Font")
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + REF, fonts.split(b">>")[0]):
            unicode = self.value(self.objects.get(int(number), b""), b"ToUnicode")
            if unicode:
                found[name] = character_map(self.stream(unicode)[1])
        return found

    def contents(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(?:" + REF + rb"|\[(.*?)\])", page, re.S)
        if not m:
            return b""
        numbers = [int(m[1])] if m[1] else [int(x) for x in re.findall(REF, m[2])]
        return b"\n".join(self.stream(self.objects.get(n, b""))[1] for n in numbers)


def character_map(data: bytes) -> dict:
    """Code to text, and under None the bytes of a code."""
    out, text = {None: 1}, lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    hexes = lambda b: [re.sub(rb"\s", b"", x) for x in re.findall(rb"<([0-9A-Fa-f\s]*)>", b)]
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        own = hexes(block)
        for code, to in zip(own[::2], own[1::2], strict=False):
            out[None] = max(1, len(code) // 2)
            out[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for lo, hi, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            out[None] = max(1, len(lo) // 2)
            first, last = int(lo, 16), min(int(hi, 16), int(lo, 16) + 0xFFFF)
            if many:
                out.update(zip(range(first, last + 1), map(text, hexes(many)), strict=False))
            else:
                base = text(to)
                out.update({c: base[:-1] + chr(min(0x10FFFF, ord(base[-1]) + c - first)) for c in range(first, last + 1) if base})
    return out


def string_bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] in (b"\r\n", b"\n", b"\r") else ESCAPES.get(m[2], m[2])
    return re.sub(rb"\\(?:([0-7]{1,3})|(\r\n|.))", plain, token[1:-1], flags=re.S)


def shown(token: bytes, font: dict | None) -> str:
    raw = string_bytes(token)
    if not font:
        return raw.decode("cp1252", "replace")
    width = font[None]
    return "".join(font.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def page_text(content: bytes, fonts: dict[bytes, dict]) -> str:
    out, held, font = [], [], None
    for m in TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/" or t[:1].isdigit() or t[:1] in b"+-.":
            held.append(t)
            continue
        strings = [x for x in held if x[:1] in b"(<"]
        if t == b"Tf":
            font = next((fonts.get(x[1:]) for x in reversed(held) if x[:1] == b"/"), None)
        elif t in (b"Tj", b"'", b'"'):
            out += ["\n"] * (t != b"Tj") + [shown(strings[-1], font)] * bool(strings)
        elif t == b"TJ":
            for x in held:
                if x[:1] in b"(<":
                    out.append(shown(x, font))
                elif x[:1] not in b"[]/" and float(x) < GAP:
                    out.append(" ")
        elif t in (b"Td", b"TD") and len(held) >= 2:
            out.append("\n" if held[-1].strip(b"[]/") and float(held[-1]) else " ")
        elif t in (b"T*", b"Tm", b"ET"):
            out.append("\n")
        held = []
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def pdf_text(data: bytes) -> str:
    """The text of each page, in order. ValueError for what is no PDF, is encrypted, or has no readable page."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF")
    own = _File(data)
    pages = own.pages()
    if not pages:
        raise ValueError("no pages")
    return "\n".join(x for x in (page_text(own.contents(p), own.fonts(p)) for p in pages) if x)
