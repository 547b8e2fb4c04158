"""Text and words of simple PDF files, for workers that have no PDF library.

Reads what digital delivery notes are made of: classic objects and object streams, streams without a filter or with
FlateDecode, one-byte fonts in WinAnsi encoding and fonts with a ToUnicode map, text placed by Td, TD, Tm, T*, Tj, TJ, ' and ".
Glyph widths come from the font's Widths where it has them, else half the size stands for one. Encrypted files and other
filters are errors, which the caller reports as an unreadable file.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


@dataclass
class Page:
    width: float
    height: float
    words: list[dict]

    @property
    def text(self) -> str:
        lines: dict[float, list[dict]] = {}
        for w in sorted(self.words, key=lambda w: (w["top"], w["x0"])):
            near = next((t for t in lines if abs(t - w["top"]) <= 2), w["top"])
            lines.setdefault(near, []).append(w)
        return "\n".join(" ".join(w["text"] for w in sorted(ws, key=lambda w: w["x0"])) for _, ws in sorted(lines.items()))


class Document:
    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF") or b"/Encrypt" in data:
            raise ValueError("not a readable PDF")
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        if not self.objects:
            raise ValueError("no objects")
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                inner, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
                at = [int(x) for x in inner[:first].split()]
                ends = [*at[3::2], len(inner) - first]
                for n, low, high in zip(at[::2], at[1::2], ends, strict=True):
                    self.objects.setdefault(n, inner[first + low : first + high])

    def stream(self, body: bytes) -> bytes:
        found = _STREAM.search(body)
        raw = found[1] if found else b""
        head = body[: found.start()] if found else body
        if b"/FlateDecode" in head:
            return zlib.decompressobj().decompress(raw)
        if b"/Filter" in head:
            raise ValueError("filter that can't be read")
        return raw

    def part(self, body: bytes, name: bytes) -> bytes:
        """The object or dictionary behind a name, b'' if there is none."""
        ref = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R\b", body)
        if ref:
            return self.objects.get(int(ref[1]), b"")
        own = re.search(rb"/" + name + rb"\s*(<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>|\[[^\]]*\])", body, re.S)
        return own[1] if own else b""

    def _pages(self, n: int, above: dict[bytes, bytes], seen: set[int]) -> list[tuple[bytes, dict[bytes, bytes]]]:
        body = self.objects.get(n, b"")
        if n in seen or not body:
            return []
        seen.add(n)
        held = {k: self.part(body, k) or v for k, v in above.items()}
        kids = self.part(body, b"Kids")
        if not re.search(rb"/Type\s*/Pages\b", body):
            return [(body, held)]
        return [p for k in re.findall(rb"(\d+)\s+\d+\s+R", kids) for p in self._pages(int(k), held, seen)]

    @property
    def pages(self) -> list[Page]:
        inherited = {b"MediaBox": b"[0 0 612 792]", b"Resources": b""}
        roots = [n for n, body in self.objects.items() if re.search(rb"/Type\s*/Pages\b", body) and not re.search(rb"/Parent\b", body)]
        return [self._page(body, held) for n in roots for body, held in self._pages(n, inherited, set())]

    def _fonts(self, resources: bytes) -> dict[bytes, tuple[dict[int, str] | None, dict[int, float]]]:
        fonts = {}
        for name, n in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", self.part(resources, b"Font")):
            body = self.objects.get(int(n), b"")
            unicode_ = self.part(body, b"ToUnicode")
            widths = [float(x) for x in re.findall(rb"[-\d.]+", self.part(body, b"Widths"))]
            start = re.search(rb"/FirstChar\s+(\d+)", body)
            fonts[name] = (_unicode_map(self.stream(unicode_)) if unicode_ else None, dict(enumerate(widths, int(start[1]) if start else 0)))
        return fonts

    def _page(self, body: bytes, held: dict[bytes, bytes]) -> Page:
        box = [float(x) for x in re.findall(rb"[-\d.]+", held[b"MediaBox"])]
        width, height = box[2] - box[0], box[3] - box[1]
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        data = b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])) if refs else b""
        return Page(width, height, _words(data, self._fonts(held[b"Resources"]), box[0], box[3]))


def _unicode_map(cmap: bytes) -> dict[int, str]:
    text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            low, first = int(a, 16), int(to, 16)
            out |= {low + i: chr(first + i) for i in range(int(b, 16) - low + 1)}
    return out


def _bytes_of(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = lambda m: _ESCAPES.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1] if m[1] != b"\n" else b"")
    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.S)


def _words(data: bytes, fonts: dict, left: float, top: float) -> list[dict]:
    words: list[dict] = []
    stack: list = []
    x = y = line_x = line_y = 0.0
    size, leading, scale = 10.0, 0.0, 1.0
    mapped, widths = None, {}

    def show(raw: bytes) -> None:
        nonlocal x
        if mapped is not None and max(mapped, default=0) > 255:
            codes = [int.from_bytes(raw[i : i + 2]) for i in range(0, len(raw), 2)]
        else:
            codes = list(raw)
        word = ""
        begin = x
        for code in [*codes, None]:
            ch = " " if code is None else (mapped.get(code, "") if mapped is not None else bytes([code]).decode("cp1252", "replace"))
            if ch.isspace():
                if word:
                    last = words[-1] if words else None
                    height = size * scale
                    if last and abs(last["bottom"] - (top - y)) < 0.01 and abs(begin - left - last["x1"]) < 0.12 * height:
                        last["text"] += word  # goes on where the one before ended
                        last["x1"] = x - left
                    else:
                        words.append({"text": word, "x0": begin - left, "x1": x - left, "top": top - y - height, "bottom": top - y})
                word = ""
            else:
                if not word:
                    begin = x
                word += ch
            if code is not None:
                x += widths.get(code, 500.0) / 1000 * size * scale

    for token in _TOKEN.findall(data):
        c = token[:1]
        if c in b"(<":
            stack.append(_bytes_of(token))
        elif c in b"[/":
            stack.append(token)
        elif c == b"]":
            items: list = []
            while stack and stack[-1] != b"[":
                items.append(stack.pop())
            stack[-1:] = [items[::-1]]
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            stack.append(float(token))
        else:
            args, stack = stack, []
            if token == b"BT":
                x = y = line_x = line_y = 0.0
                scale = 1.0
            elif token == b"Tf" and len(args) >= 2:
                mapped, widths = fonts.get(args[-2][1:], (None, {}))
                size = args[-1]
            elif token == b"TL":
                leading = args[-1]
            elif token in (b"Td", b"TD") and len(args) >= 2:
                leading = -args[-1] if token == b"TD" else leading
                line_x, line_y = line_x + args[-2] * scale, line_y + args[-1] * scale
                x, y = line_x, line_y
            elif token == b"Tm" and len(args) >= 6:
                scale, line_x, line_y = abs(args[-3]) or 1.0, args[-2], args[-1]
                x, y = line_x, line_y
            elif token in (b"T*", b"'", b'"'):
                line_y -= leading * scale
                x, y = line_x, line_y
            if token in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
                show(args[-1])
            elif token == b"TJ" and args and isinstance(args[-1], list):
                for item in args[-1]:
                    if isinstance(item, bytes):
                        show(item)
                    else:
                        x -= item / 1000 * size * scale
    return words
