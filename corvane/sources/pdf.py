"""The text layer of PDF files: words with their boxes and lines, page by page, and where pictures cover a page.

Objects are reached through cross-reference tables and streams, and by a scan
of the file where these are broken.  What is drawn with text operators becomes
words; nothing is rendered.  Encrypted files are an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import Any, NamedTuple


class Name(str):
    """A name or an operator of the syntax, as against a string's bytes."""


class Ref(NamedTuple):
    number: int
    generation: int


class PdfError(ValueError):
    """The file cannot be read as PDF."""


MOST_BYTES = 1 << 28  # a stream that inflates beyond is refused
_SPACE = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_STRING = re.compile(rb"[()\\]")
# fixed values: what follows a backslash in a string
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_CLOSE = {b"[": b"]", b"<<": b">>"}
_CONSTANTS = {b"true": True, b"false": False, b"null": None}


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening bracket is at ``at``, and where it ends; inner brackets balance."""
    out, depth, last = [], 1, at + 1
    while m := _STRING.search(data, last):
        out.append(data[last : m.start()])
        last = m.end()
        if m[0] == b"\\":
            octal = re.compile(rb"[0-7]{1,3}|\r\n|.", re.DOTALL).match(data, last)
            mark = octal[0] if octal else b""
            last += len(mark)
            out.append(bytes([int(mark, 8) & 255]) if mark[:1].isdigit() and mark < b"8" else b"" if mark in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(mark, mark))
            continue
        depth += 1 if m[0] == b"(" else -1
        if not depth:
            return b"".join(out), last
        out.append(m[0])
    raise PdfError("a string does not end")


def value(data: bytes, at: int) -> tuple[Any, int]:
    """The value or operator at ``at`` and where it ends; None and the end of data where there is none."""
    at = _SPACE.match(data, at).end()
    two, one = data[at : at + 2], data[at : at + 1]
    if not one:
        return None, at
    if two == b"<<" or one == b"[":
        close, items, at = _CLOSE[two if two == b"<<" else one], [], at + (2 if two == b"<<" else 1)
        while True:
            at = _SPACE.match(data, at).end()
            if data.startswith(close, at):
                at += len(close)
                return (items if close == b"]" else dict(zip(items[::2], items[1::2]))), at
            if at >= len(data):
                raise PdfError("a list or dictionary does not end")
            item, at = value(data, at)
            items.append(item)
    if one == b"(":
        return literal(data, at)
    if one == b"<":
        end = data.find(b">", at) % (len(data) + 1)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if one == b"/":
        m = _WORD.match(data, at + 1)
        raw = m[0] if m else b""
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1")), at + 1 + len(raw)
    if m := _REF.match(data, at):
        return Ref(int(m[1]), int(m[2])), m.end()
    m = _WORD.match(data, at)
    if not m:
        return Name(one.decode("latin-1")), at + 1
    if _NUMBER.match(m[0]):
        return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    return _CONSTANTS.get(m[0], Name("\x00" + m[0].decode("latin-1"))), m.end()  # an operator is marked


def unpredicted(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Rows of PNG filters undone."""
    wide, step = (columns * colors * bits + 7) // 8, max(1, colors * bits // 8)
    out, before = bytearray(), bytes(wide)
    for at in range(0, len(data), wide + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + wide].ljust(wide, b"\0"))
        for i in range(wide):
            left, up, corner = row[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            near = min((left, up, corner), key=lambda x: abs(left + up - corner - x)) if kind == 4 else 0
            row[i] = (row[i] + (0, left, up, (left + up) // 2, near)[kind]) & 255
        out += row
        before = bytes(row)
    return bytes(out)


class Pdf:
    """Objects of a file by number; what is asked for is parsed then."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"%PDF"):
            raise PdfError("no PDF header")
        self.data, self.at, self.trailer, self._made = data, {}, {}, {}
        try:
            self._chain(int(re.findall(rb"startxref\s+(\d+)", data)[-1]))
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfError("no root")
        except (PdfError, ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error):
            self._scan()
        if "Encrypt" in self.trailer:
            raise PdfError("the file is encrypted")
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise PdfError("no document catalogue")

    def _chain(self, start: int | None) -> None:
        """Cross-reference sections from the last to the first; a number's latest place counts."""
        seen = set()
        todo = [start]
        while todo:
            at = todo.pop(0)
            if at is None or at in seen:
                continue
            seen.add(at)
            at = _SPACE.match(self.data, at).end()
            if self.data.startswith(b"xref", at):
                at += 4
                while m := re.compile(rb"\s*(\d+)\s+(\d+)\s*[\r\n]").match(self.data, at):
                    at = m.end()
                    for number in range(int(m[1]), int(m[1]) + int(m[2])):
                        row = re.compile(rb"\s*(\d{10})\s(\d{5})\s([nf])").match(self.data, at)
                        at = row.end()
                        self.at.setdefault(number, int(row[1]) if row[3] == b"n" else None)
                trailer, _ = value(self.data, self.data.index(b"trailer", at) + 7)
            else:
                trailer, body = self._object(at)
                wide = trailer["W"]
                index = trailer.get("Index") or [0, trailer["Size"]]
                rows = iter(range(0, len(body), sum(wide)))
                for first, many in zip(index[::2], index[1::2]):
                    for number, row in zip(range(first, first + many), rows):
                        cells = [body[row + sum(wide[:i]) : row + sum(wide[: i + 1])] for i in range(3)]
                        kind, a, b = (int.from_bytes(c, "big") if c else d for c, d in zip(cells, (1, 0, 0)))
                        self.at.setdefault(number, a if kind == 1 else (a, b) if kind == 2 else None)
            self.trailer = {**trailer, **self.trailer}
            todo += [trailer.get("XRefStm"), trailer.get("Prev")]

    def _scan(self) -> None:
        """Places of all objects from the file's text; later ones count."""
        self.at, self._made, self.trailer = {int(m[1]): m.start() for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", self.data)}, {}, {}
        for m in re.finditer(rb"\btrailer\b", self.data):
            try:
                found, _ = value(self.data, m.end())
                self.trailer |= found if isinstance(found, dict) else {}
            except PdfError:
                continue
        for number in list(self.at):
            try:
                own = self.get(Ref(number, 0))
            except (PdfError, zlib.error):
                continue
            if isinstance(own, tuple) and own[0].get("Type") == "ObjStm":
                for i, inner in enumerate(self._inner(number)):
                    self.at.setdefault(inner, (number, i))
            if isinstance(own, tuple) and own[0].get("Type") == "XRef":
                self.trailer |= {k: v for k, v in own[0].items() if k in ("Root", "Encrypt")}
        for number in list(self.at) if "Root" not in self.trailer else ():
            own = self.get(Ref(number, 0))
            if isinstance(own, dict) and own.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(number, 0)

    def _object(self, at: int) -> Any:
        """The object whose head is at ``at``: a stream is (dictionary, bytes)."""
        m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        if not m:
            raise PdfError("no object where one should be")
        own, end = value(self.data, m.end())
        m = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, end)
        if not (m and isinstance(own, dict)):
            return own
        size = self.get(own.get("Length"))
        stop = m.end() + size if isinstance(size, int) else -1
        if stop < 0 or not re.compile(rb"\s*endstream").match(self.data, stop):
            stop = self.data.find(b"endstream", m.end())
        return own, self._decoded(own, self.data[m.end() : stop if stop >= 0 else len(self.data)])

    def _decoded(self, own: dict, raw: bytes) -> bytes:
        many = lambda x: x if isinstance(x, list) else [x]
        settings = many(self.get(own.get("DecodeParms")))
        for i, kind in enumerate(many(self.get(own.get("Filter"))) if own.get("Filter") is not None else ()):
            if kind in ("FlateDecode", "Fl"):
                box = zlib.decompressobj()
                raw = box.decompress(raw, MOST_BYTES)
                if box.unconsumed_tail:
                    raise PdfError("a stream is too long")
                told = self.get(settings[i]) if i < len(settings) else None
                if told and told.get("Predictor", 1) >= 10:
                    raw = unpredicted(raw, told.get("Columns", 1), told.get("Colors", 1), told.get("BitsPerComponent", 8))
            elif kind in ("ASCIIHexDecode", "AHx"):
                raw = value(b"<" + raw.rstrip().rstrip(b">") + b">", 0)[0]
            else:
                return raw  # pictures stay as they are
        return raw

    def _inner(self, number: int) -> dict[int, Any]:
        """Numbers and values of an object stream."""
        own, body = self.get(Ref(number, 0))
        first, heads, at = own["First"], [], 0
        for _ in range(2 * own["N"]):
            head, at = value(body, at)
            heads.append(head)
        return {n: value(body, first + o)[0] for n, o in zip(heads[::2], heads[1::2])}

    def get(self, x: Any) -> Any:
        """The object behind a reference, anything else itself."""
        for _ in range(16):
            if not isinstance(x, Ref):
                return x
            if x.number not in self._made:
                self._made[x.number] = None  # an object that needs itself is null
                place = self.at.get(x.number)
                if isinstance(place, tuple):
                    self._made |= {n: v for n, v in self._inner(place[0]).items() if self.at.get(n) == place or n == x.number or isinstance(self.at.get(n), tuple)}
                elif place is not None:
                    self._made[x.number] = self._object(place)
            x = self._made[x.number]
        return None

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with what they inherit."""
        todo, seen = [(self.get(self.trailer["Root"]).get("Pages"), {})], set()
        while todo:
            ref, held = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(ref)
            own = held | {k: node[k] for k in ("Resources", "MediaBox", "CropBox") if k in node}
            if "Kids" in node:
                todo += [(kid, own) for kid in reversed(self.get(node["Kids"]) or [])]
            else:
                yield node | own


# ---- fonts


def to_unicode(cmap: bytes) -> dict[int, str]:
    """Codes to text from the character and range lists of a ToUnicode map."""
    out: dict[int, str] = {}
    at, stack = 0, []
    code = lambda b: int.from_bytes(b, "big")
    text = lambda b: b.decode("utf-16-be", "replace")
    while at < len(cmap):
        item, at = value(cmap, at)
        if item == "\x00endbfchar":
            out |= {code(a): text(b) for a, b in zip(stack[::2], stack[1::2])}
        elif item == "\x00endbfrange":
            for low, high, to in zip(stack[::3], stack[1::3], stack[2::3]):
                span = range(code(low), min(code(high), code(low) + 65_535) + 1)
                out |= {c: text(t) for c, t in zip(span, to)} if isinstance(to, list) else {c: text(to[:-2] + (code(to[-2:]) + c - span[0] & 65_535).to_bytes(2, "big")) for c in span}
        stack = [] if isinstance(item, str) and item.startswith("\x00") else [*stack, item]
    return out


class Font:
    """Codes of a string to (text, width in thousandths, is a single-byte blank)."""

    def __init__(self, pdf: Pdf, own: dict) -> None:
        get, self._visible = pdf.get, None
        inner = (get((get(own.get("DescendantFonts")) or [None])[0]) or {}) if own.get("Subtype") == "Type0" else None
        self.size, self.widths = (1 if inner is None else 2), {}
        stream = get(own.get("ToUnicode"))
        self.map = to_unicode(stream[1]) if isinstance(stream, tuple) else {}
        if inner is None:
            self.default, first = 500, get(own.get("FirstChar")) or 0
            self.widths = {first + i: get(w) for i, w in enumerate(get(own.get("Widths")) or [])}
            coding = get(own.get("Encoding"))
            base = coding.get("BaseEncoding") if isinstance(coding, dict) else coding
            for c in range(256):
                self.map.setdefault(c, bytes([c]).decode("mac-roman" if base == "MacRomanEncoding" else "cp1252", "replace"))
            code = 0
            for item in get(coding.get("Differences")) or [] if isinstance(coding, dict) and not isinstance(stream, tuple) else ():
                if isinstance(item, int):
                    code = item
                else:
                    plain = re.fullmatch(r"uni([0-9A-F]{4})|(.)|space()", item, re.DOTALL)
                    self.map[code] = self.map.get(code, "") if not plain else bytes.fromhex(plain[1]).decode("utf-16-be", "replace") if plain[1] else plain[2] or " "
                    code += 1
            return
        self.default, at, listed = get(inner.get("DW")) or 1000, 0, [get(x) for x in get(inner.get("W")) or []]
        while at + 1 < len(listed):
            if isinstance(listed[at + 1], list):
                self.widths |= {listed[at] + i: get(w) for i, w in enumerate(listed[at + 1])}
                at += 2
            else:
                self.widths |= dict.fromkeys(range(listed[at], min(listed[at + 1], listed[at] + 65_535) + 1), listed[at + 2] if at + 2 < len(listed) else self.default)
                at += 3

    def runs(self, string: bytes) -> tuple[str, list[tuple[int, int, str]]] | None:
        """The codes as characters, and (start, stop, text) of the runs of codes that have visible text; None where codes and characters do not correspond."""
        if self._visible is None:
            own = {c: t for c, t in self.map.items() if t and not t.isspace() and c < 65_536}
            self._visible, self._text = re.compile("[%s]+" % "".join(f"\\u{c:04x}" for c in own) if own else r"(?!)"), own
        codes = string.decode("latin-1") if self.size == 1 else string[: len(string) & ~1].decode("utf-16-be", "surrogatepass")
        if len(codes) != len(string) // self.size:
            return None
        return codes, [(*m.span(), m[0].translate(self._text)) for m in self._visible.finditer(codes)]

    def read(self, string: bytes) -> Iterator[tuple[str, float, bool]]:
        for i in range(0, len(string) - self.size + 1, self.size):
            code = int.from_bytes(string[i : i + self.size], "big")
            yield self.map.get(code, ""), self.widths.get(code, self.default), self.size == 1 and code == 32


# ---- what a page draws


def times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Drawing:
    """Glyphs or adjoining runs of them (text, x0, x1, baseline, size) and picture boxes of a page, in the order in which they are drawn."""

    def __init__(self, pdf: Pdf) -> None:
        self.pdf, self.glyphs, self.pictures, self.fonts = pdf, [], [], {}

    def run(self, content: bytes, resources: dict, base: tuple = UNIT, depth: int = 0) -> None:
        get = self.pdf.get
        part = lambda kind, name: get((get((get(resources) or {}).get(kind)) or {}).get(name))
        state = {"ctm": base, "font": None, "size": 1.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
        held, line, here, args, at = [], UNIT, UNIT, [], 0
        plain = {"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}
        while at < len(content):
            item, at = value(content, at)
            if not (isinstance(item, str) and item.startswith("\x00")):
                args.append(item)
                continue
            op, args, a = item[1:], [], args
            if op == "q":
                held.append(dict(state))
            elif op == "Q" and held:
                state = held.pop()
            elif op == "cm" and len(a) == 6:
                state["ctm"] = times(tuple(a), state["ctm"])
            elif op == "BT":
                line = here = UNIT
            elif op == "Tf" and len(a) == 2:
                own = part("Font", a[0])
                key = id(own)
                if key not in self.fonts:
                    self.fonts[key] = (own, Font(self.pdf, own)) if isinstance(own, dict) else (own, None)
                state |= {"font": self.fonts[key][1], "size": a[1]}
            elif op in plain and a:
                state[plain[op]] = a[0]
            elif op == "Tz" and a:
                state["scale"] = a[0] / 100
            elif op in ("Td", "TD") and len(a) == 2:
                if op == "TD":
                    state["lead"] = -a[1]
                line = here = times((1, 0, 0, 1, *a), line)
            elif op == "Tm" and len(a) == 6:
                line = here = tuple(a)
            elif op in ("T*", "'", '"'):
                if op == '"' and len(a) == 3:
                    state["word"], state["char"] = a[:2]
                line = here = times((1, 0, 0, 1, 0, -state["lead"]), line)
            elif op == "Do" and a:
                own = part("XObject", a[0])
                if isinstance(own, tuple) and own[0].get("Subtype") == "Image":
                    xs, ys = zip(*((times((1, 0, 0, 1, x, y), state["ctm"])[4:]) for x in (0, 1) for y in (0, 1)))
                    self.pictures.append((min(xs), min(ys), max(xs), max(ys)))
                elif isinstance(own, tuple) and own[0].get("Subtype") == "Form" and depth < 8:
                    self.run(own[1], own[0].get("Resources", resources), times(tuple(get(own[0].get("Matrix")) or UNIT), state["ctm"]), depth + 1)
            elif op == "BI":  # an inline picture's bytes are no operators
                end = re.compile(rb"\sEI(?=[\s]|$)").search(content, at)
                at = end.end() if end else len(content)
            if op in ("Tj", "'", '"', "TJ") and a and state["font"] is not None:
                for x in a[-1] if isinstance(a[-1], list) else [a[-1]]:
                    if isinstance(x, bytes):
                        here = self._show(x, state, here)
                    elif isinstance(x, (int, float)):
                        here = times((1, 0, 0, 1, -x / 1000 * state["size"] * state["scale"], 0), here)

    def _show(self, string: bytes, state: dict, here: tuple) -> tuple:
        font, size, scale, char = state["font"], state["size"], state["scale"], state["char"]
        right, up, lean, rising, x, y = times(here, state["ctm"])
        x, y = x + state["rise"] * lean, y + state["rise"] * rising
        high = size * (lean**2 + rising**2) ** 0.5
        moved = self._show_level(string, state, right * scale, x, y, high) if right > 0 and scale > 0 and not up and not lean and 0 <= char * scale * right <= 0.25 * high else None
        if moved is None:  # glyph by glyph
            moved = 0.0
            for text, width, blank in font.read(string):
                end = moved + width / 1000 * size * scale
                a, b = x + moved * right, x - state["rise"] * lean + end * right
                self.glyphs.append((text, min(a, b), max(a, b), y + moved * up, high))
                moved = end + (char + (state["word"] if blank else 0)) * scale
        return times((1, 0, 0, 1, moved, 0), here)

    def _show_level(self, string: bytes, state: dict, unit: float, x: float, y: float, high: float) -> float | None:
        """A level string whose glyphs adjoin: its runs of visible glyphs as one each, and a blank for all between them.  How far it moves, or None where a glyph must be looked at alone."""
        font, size, char = state["font"], state["size"], state["char"]
        found = font.runs(string)
        if found is None or size < 0:
            return None
        codes, runs = found
        many, spaced = len(codes), bool(state["word"]) and font.size == 1 and " " in codes
        if font.widths or spaced:
            wide = [font.widths.get(ord(c), font.default) / 1000 * size for c in codes]
            if (spaced and font._text.get(32)) or min(wide, default=0) < 0:
                return None
            step = [w + char + (state["word"] if spaced and c == " " else 0) for w, c in zip(wide, codes)]
            at = [0.0, *accumulate(step)]
            begin, end = (lambda i: x + at[i] * unit), (lambda i: x + (at[i - 1] + wide[i - 1]) * unit)
        else:
            wide = font.default / 1000 * size
            step = wide + char
            if wide < 0:
                return None
            begin, end = (lambda i: x + i * step * unit), (lambda i: x + ((i - 1) * step + wide) * unit)
            at = {many: many * step}
        last = 0
        for start, stop, text in runs:
            if start > last:
                self.glyphs.append((" ", begin(last), end(start), y, high))
            self.glyphs.append((text, begin(start), end(stop), y, high))
            last = stop
        if many > last:
            self.glyphs.append((" ", begin(last), end(many), y, high))
        return at[many] * state["scale"]


def words(glyphs: list[tuple], left: float, top: float) -> list[tuple[str, int, float, float, float, float]]:
    """(word, line, x0, y0, x1, y1) with y down from the page's top: a word ends at a blank, a gap of a quarter of its size or another baseline."""
    out: list[list] = []
    line, last, fresh = -1, None, True
    for text, x0, x1, base, high in glyphs:
        moved = last is None or abs(base - last[2]) > 0.5 * max(high, 0.1)
        if moved:
            line += 1
        if not text or text.isspace():
            fresh, last = True, (text, x1, base)
            continue
        box = [x0 - left, top - base - 0.8 * high, x1 - left, top - base + 0.2 * high]
        if fresh or moved or not -0.5 * high <= x0 - last[1] <= 0.25 * high:
            out.append([text, line, *box])
        else:
            w = out[-1]
            out[-1] = [w[0] + text, line, min(w[2], box[0]), min(w[3], box[1]), max(w[4], box[2]), max(w[5], box[3])]
        fresh, last = False, (text, x1, base)
    return [tuple(w) for w in out]


def read_pages(data: bytes, part: int = 0, parts: int = 1) -> Iterator[dict]:
    """page (from 1), width, height, text (a line a line), words, pictures of each page, or its error; only every ``parts``-th page."""
    pdf = Pdf(data)
    for number, page in enumerate(pdf.pages(), 1):
        if (number - 1) % parts != part:
            continue
        try:
            x0, y0, x1, y1 = (float(pdf.get(x)) for x in pdf.get(page.get("CropBox") or page.get("MediaBox")) or (0, 0, 612, 792))
            content = pdf.get(page.get("Contents"))
            streams = [pdf.get(c) for c in content] if isinstance(content, list) else [content]
            drawing = Drawing(pdf)
            drawing.run(b"\n".join(s[1] for s in streams if isinstance(s, tuple)), page.get("Resources") or {})
            own = words(drawing.glyphs, x0, y1)
            lines: dict[int, list[str]] = {}
            for w in own:
                lines.setdefault(w[1], []).append(w[0])
            boxes = [(max(a, x0) - x0, y1 - min(d, y1), min(c, x1) - x0, y1 - max(b, y0)) for a, b, c, d in drawing.pictures]
            yield {"page": number, "width": x1 - x0, "height": y1 - y0, "text": "\n".join(" ".join(x) for x in lines.values()), "words": own, "pictures": boxes, "error": None}
        except (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError, zlib.error) as e:
            yield {"page": number, "width": None, "height": None, "text": None, "words": [], "pictures": [], "error": f"{type(e).__name__}: {e}"}


# ---- a writer, for trials


def build_pdf(pages: list[list[str]], scans: frozenset[int] | set[int] = frozenset(), streams: bool = False) -> bytes:
    """Pages of lines in one two-byte font with a ToUnicode map; pages in ``scans`` (from 1) are covered by a picture.

    With ``streams`` content is deflated and objects are in object and cross-reference streams.
    """
    chars = {c: i for i, c in enumerate(dict.fromkeys("".join(x for p in pages for x in p)), 1)}
    objects: dict[int, bytes] = {}
    packed = {}

    def stream(number: int, body: bytes, more: bytes = b"") -> None:
        if streams:
            body, more = zlib.compress(body), more + b"/Filter/FlateDecode"
        objects[number] = b"<<%s/Length %d>>stream\n%s\nendstream" % (more, len(body), body)

    rows = [b"<%04x> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for c, i in chars.items()]
    lists = [b"%d beginbfchar\n%s\nendbfchar" % (len(x), b"\n".join(x)) for x in (rows[i : i + 100] for i in range(0, len(rows), 100))]
    stream(5, b"/CIDInit /ProcSet findresource begin begincmap\n" + b"\n".join(lists) + b"\nendcmap end")
    stream(6, b"\xff", b"/Type/XObject/Subtype/Image/Width 1/Height 1/ColorSpace/DeviceGray/BitsPerComponent 8")
    packed[1] = b"<</Type/Catalog/Pages 2 0 R>>"
    packed[2] = b"<</Type/Pages/MediaBox[0 0 612 792]/Resources<</Font<</F 3 0 R>>/XObject<</I 6 0 R>>>>/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % (7 + 2 * i) for i in range(len(pages))))
    packed[3] = b"<</Type/Font/Subtype/Type0/BaseFont/F/Encoding/Identity-H/DescendantFonts[4 0 R]/ToUnicode 5 0 R>>"
    packed[4] = b"<</Type/Font/Subtype/CIDFontType2/BaseFont/F/DW 500>>"
    for i, page in enumerate(pages):
        packed[7 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (8 + 2 * i)
        shown = b"".join(b"<%s>Tj T*\n" % "".join(f"{chars[c]:04x}" for c in x).encode() for x in page)
        stream(8 + 2 * i, (b"q 612 0 0 792 0 0 cm /I Do Q\n" if i + 1 in scans else b"") + b"BT /F 10 Tf 12 TL 40 750 Td\n" + shown + b"ET")
    last = 7 + 2 * len(pages)
    if streams:
        bodies, heads, at = [], [], 0
        for n, body in packed.items():
            heads.append(b"%d %d" % (n, at))
            bodies.append(body)
            at += len(body) + 1
        head = b" ".join(heads) + b"\n"
        stream(last, head + b"\n".join(bodies), b"/Type/ObjStm/N %d/First %d" % (len(packed), len(head)))
    else:
        objects |= packed
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for n, body in sorted(objects.items()):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start, total = len(out), last + (2 if streams else 0)
    if streams:
        order = {n: i for i, n in enumerate(packed)}
        places[last + 1] = start
        cell = lambda n: b"\x02" + last.to_bytes(4, "big") + order[n].to_bytes(4, "big") if n in order else (b"\x01" + places[n].to_bytes(4, "big") if n in places else bytes(5)) + bytes(4)
        stream(last + 1, b"".join(map(cell, range(total))), b"/Type/XRef/W[1 4 4]/Size %d/Root 1 0 R" % total)
        out += b"%d 0 obj\n%s\nendobj\n" % (last + 1, objects[last + 1])
    else:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % total + b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, total)) + b"trailer<</Size %d/Root 1 0 R>>\n" % total
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)
