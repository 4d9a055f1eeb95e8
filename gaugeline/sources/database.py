"""Message databases: what the bits of a frame mean. Loaders give a ``Database``; ``tables`` gives it as
DataFrames for joins, and ``gaugeline.operators.bus`` decodes frames with it."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

ID_MASK = 0x1FFFFFFF
MAX_MUX_DEPTH = 64


class DatabaseError(ValueError):
    """A database text that can't be read as a whole."""


@dataclass(frozen=True)
class Mux:
    """When a signal is present: ``selected`` on one value of the message's switch, or on ranges of a
    named multiplexor; ``switch`` marks the switch itself."""

    kind: str = "none"
    value: int = 0
    multiplexor: str = ""
    ranges: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class SignalDef:
    name: str
    start_bit: int
    size: int
    big_endian: bool = False
    signed: bool = False
    factor: float = 1.0
    offset: float = 0.0
    unit: str = ""
    mux: Mux = Mux()
    labels: tuple[tuple[int, str], ...] = ()


@dataclass(frozen=True)
class MessageDef:
    name: str
    id: int
    extended: bool
    length: int
    signals: tuple[SignalDef, ...]


def pgn_of(can_id: int) -> int:
    """The parameter group: the low byte of a group below 240 is an address."""
    group = can_id >> 8 & 0x3FFFF
    return group & 0x3FF00 if group >> 8 & 0xFF < 240 else group


@dataclass(frozen=True)
class Database:
    """Messages and the rule that finds one for an identifier: ``exact``, ``pgn`` or ``pgn_source``."""

    messages: tuple[MessageDef, ...]
    matching: str = "exact"
    index: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        for i, m in enumerate(self.messages):
            self.index[("id", m.id & ID_MASK)] = i  # of equal ids the last counts
            self.index.setdefault(("pgn", pgn_of(m.id)), i)  # of equal groups the first
            self.index.setdefault(("src", pgn_of(m.id), m.id & 0xFF), i)

    def with_matching(self, matching: str) -> Database:
        if matching not in ("exact", "pgn", "pgn_source"):
            raise ValueError(f"unknown matching {matching}")
        return replace(self, matching=matching, index={})

    def find(self, can_id: int) -> int | None:
        can_id &= ID_MASK
        got = self.index.get(("id", can_id))
        if got is None and self.matching == "pgn_source":
            got = self.index.get(("src", pgn_of(can_id), can_id & 0xFF))
        if got is None and self.matching != "exact":
            got = self.index.get(("pgn", pgn_of(can_id)))
        return got

    def message(self, name: str) -> MessageDef | None:
        return next((m for m in self.messages if m.name == name), None)

    def name_of(self, can_id: int) -> str | None:
        i = self.find(can_id)
        return None if i is None else self.messages[i].name

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(messages, signals) as small DataFrames."""
        messages = [(i, m.name, m.id & ID_MASK, m.extended, m.length, pgn_of(m.id), m.id & 0xFF) for i, m in enumerate(self.messages)]
        signals = [
            (i, j, s.name, s.start_bit, s.size, s.big_endian, s.signed, s.factor, s.offset, s.unit, s.mux.kind, s.mux.value, s.mux.multiplexor, [list(r) for r in s.mux.ranges], dict(s.labels))
            for i, m in enumerate(self.messages) for j, s in enumerate(m.signals)
        ]
        return (
            spark.createDataFrame(messages, "msg_idx int, name string, id long, extended boolean, length int, pgn int, source int"),
            spark.createDataFrame(signals, "msg_idx int, sig_idx int, name string, start_bit int, size int, big_endian boolean, signed boolean, factor double, offset double, unit string, mux_kind string, mux_value long, multiplexor string, ranges array<array<long>>, labels map<long, string>"),
        )


def check_multiplexing(message: MessageDef) -> None:
    """Rejects multiplexors that select each other in a circle or are nested too deep."""
    by = {s.name: s for s in message.signals}
    for s in message.signals:
        at, depth, met = s, 0, set()
        while at.mux.kind == "ranges":
            if at.name in met or depth > MAX_MUX_DEPTH:
                raise DatabaseError(f"multiplexors of {s.name} in {message.name} form a circle or are nested deeper than {MAX_MUX_DEPTH}")
            met.add(at.name)
            depth += 1
            at = by[at.mux.multiplexor]


# -- DBC ---------------------------------------------------------------------------------------------

_SIGNAL = re.compile(
    r"""SG_\s+(?P<name>\w+)\s*(?P<mux>m\d+M?|M)?\s*:\s*(?P<start>\d+)\|(?P<size>\d+)@(?P<order>[01])(?P<sign>[+-])\s*"""
    r"""\(\s*(?P<factor>[-+\d.eE]+)\s*,\s*(?P<offset>[-+\d.eE]+)\s*\)\s*\[[^\]]*\]\s*"(?P<unit>[^"]*)"[^\n]*"""
)
_MESSAGE = re.compile(r"BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)\s+(\w+)")
_STATEMENTS = ("VERSION", "NS_", "BS_", "BU_", "BO_", "SG_", "EV_", "VAL_TABLE_", "VAL_", "CM_", "BA_DEF_", "BA_DEF_DEF_", "BA_", "SIG_GROUP_", "SG_MUL_VAL_", "SIG_VALTYPE_", "BO_TX_BU_", "BA_REL_", "BA_DEF_REL_", "BA_DEF_DEF_REL_", "BU_SG_REL_", "BU_EV_REL_", "BU_BO_REL_", "ENVVAR_DATA_", "CAT_DEF_", "CAT_", "FILTER", "SGTYPE_", "SGTYPE_VAL_", "BA_DEF_SGTYPE_", "BA_SGTYPE_", "SIG_TYPE_REF_", "SIGTYPE_VALTYPE_", "DEF_", "SIG_TYPE_")


def _pairs(text: str) -> list[tuple[int, str]]:
    return [(int(a), b) for a, b in re.findall(r'(-?\d+)\s+"((?:[^"\\]|\\.)*)"', text)]


def parse_dbc(text: str | bytes) -> Database:
    """A DBC text; it has to be UTF-8 and made of known statements."""
    if isinstance(text, bytes):
        try:
            text = text.decode("utf-8")
        except UnicodeDecodeError as e:
            raise DatabaseError(f"the database is not UTF-8: {e}") from e
    if not re.match(r'\s*(VERSION\s+"[^"]*"|NS_|BS_|BU_|BO_)', text):
        raise DatabaseError("the text does not begin as a DBC database")
    quoted = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
    bare = quoted.sub('""', text)
    for line in bare.split("\n"):
        word = re.match(r"([A-Za-z_]\w*)", line)
        if word and word[1] not in _STATEMENTS:
            raise DatabaseError(f"unknown statement {word[1]}")
    found: list[tuple[int, str, int, list]] = []
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("BO_ "):
            m = _MESSAGE.match(s)
            if not m:
                raise DatabaseError(f"unreadable message: {s[:60]}")
            found.append((int(m[1]), m[2], int(m[3]), []))
        elif s.startswith("SG_ "):
            m = _SIGNAL.match(s)
            if not m or not found:
                raise DatabaseError(f"unreadable signal: {s[:60]}")
            found[-1][3].append(m.groupdict())
    tables = {name: _pairs(body) for name, body in re.findall(r'VAL_TABLE_\s+(\w+)\s+((?:-?\d+\s+"(?:[^"\\]|\\.)*"\s*)*);', text)}
    labels = {(int(i), n): _pairs(body) for i, n, body in re.findall(r'VAL_\s+(\d+)\s+(\w+)\s+((?:-?\d+\s+"(?:[^"\\]|\\.)*"\s*)*);', text)}
    named = {}
    for attribute, i, n, value in re.findall(r'BA_\s+"(ValTable|GenSigValTable)"\s+SG_\s+(\d+)\s+(\w+)\s+"([^"]*)"\s*;', text):
        named.setdefault((int(i), n), {})[attribute] = value
    common = dict(re.findall(r'BA_DEF_DEF_\s+"(ValTable|GenSigValTable)"\s+"([^"]*)"\s*;', text))
    extended = {}
    for i, n, mux, ranges in re.findall(r"SG_MUL_VAL_\s+(\d+)\s+(\w+)\s+(\w+)\s+([\d\s,-]+);", text):
        extended.setdefault((int(i), n), (mux, tuple((int(a), int(b)) for a, b in re.findall(r"(\d+)\s*-\s*(\d+)", ranges))))
    messages = []
    for raw, name, length, signals in found:
        names = {s["name"] for s in signals}
        out = []
        for s in signals:
            key = (raw, s["name"])
            mux = Mux()
            if s["mux"] == "M":
                mux = Mux("switch")
            elif s["mux"]:
                mux = Mux("selected", int(s["mux"].strip("mM")))
            if key in extended:
                if extended[key][0] not in names:
                    raise DatabaseError(f"multiplexor {extended[key][0]} is not in message {name}")
                mux = Mux("ranges", multiplexor=extended[key][0], ranges=extended[key][1])
            attributes = common | named.get(key, {})
            table = dict(tables.get(attributes.get("ValTable") or attributes.get("GenSigValTable") or "", []))
            table.update(labels.get(key, []))
            out.append(SignalDef(s["name"], int(s["start"]), int(s["size"]), s["order"] == "0", s["sign"] == "-", float(s["factor"]), float(s["offset"]), s["unit"], mux, tuple(table.items())))
        message = MessageDef(name, raw & ID_MASK, bool(raw & 0x80000000), length, tuple(out))
        check_multiplexing(message)
        messages.append(message)
    return Database(tuple(messages))


# -- LDF ---------------------------------------------------------------------------------------------

_LDF_TOKEN = re.compile(r'\s*(?:(?P<text>"[^"]*")|(?P<mark>[{}:;,=])|(?P<word>[^\s{}:;,="]+))')


def _ldf_tokens(text: str) -> list[str]:
    text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
    text = re.sub(r"//[^\n]*", " ", text)
    out, at = [], 0
    while at < len(text):
        m = _LDF_TOKEN.match(text, at)
        if not m:
            if text[at:].strip():
                raise DatabaseError(f"unreadable text {text[at : at + 20]!r}")
            break
        out.append(m[m.lastgroup])
        at = m.end()
    return out


def _tree(tokens: list[str], at: int = 0, depth: int = 0) -> tuple[list, int]:
    """Statements (a list of words) and blocks (head words, body) up to the closing brace."""
    out: list = []
    head: list[str] = []
    while at < len(tokens):
        t = tokens[at]
        at += 1
        if t == "{":
            body, at = _tree(tokens, at, depth + 1)
            out.append((head, body))
            head = []
        elif t == "}":
            if not depth:
                raise DatabaseError("a closing brace too many")
            return out, at
        elif t == ";":
            if head:
                out.append(head)
            head = []
        else:
            head.append(t)
    if depth or head:
        raise DatabaseError("the description ends too early")
    return out, at


def _number(text: str) -> int:
    return int(text, 0)


def _fields(words: list[str]) -> list[str]:
    return [w for w in words if w not in (",", ":", "=")]


def parse_ldf(text: str | bytes) -> Database:
    """A LIN description file: frames as messages, encodings as scales and labels."""
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    top, _ = _tree(_ldf_tokens(text))
    if not any(isinstance(x, list) and x[:1] == ["LIN_description_file"] for x in top):
        raise DatabaseError("the text is no LIN description file")
    blocks = {x[0][0]: x[1] for x in top if isinstance(x, tuple) and x[0]}
    sizes = {w[0]: _number(w[1]) for w in (_fields(x) for name in ("Signals", "Diagnostic_signals") for x in blocks.get(name, []) if isinstance(x, list))}
    scales: dict[str, dict] = {}
    for x in blocks.get("Signal_encoding_types", []):
        if isinstance(x, tuple):
            e = scales.setdefault(x[0][0], {"factor": 1.0, "offset": 0.0, "unit": "", "signed": False, "labels": []})
            for y in x[1]:
                w = _fields(y)
                if w[0] == "physical_value":
                    e |= {"factor": float(w[3]), "offset": float(w[4]), "unit": w[5].strip('"') if len(w) > 5 else ""}
                    e["signed"] = e["signed"] or float(w[1]) < 0
                elif w[0] == "logical_value":
                    e["labels"].append((_number(w[1]), w[2].strip('"') if len(w) > 2 else ""))
    encoding = {}
    for x in blocks.get("Signal_representation", []):
        w = _fields(x)
        for name in w[1:]:
            encoding[name] = w[0]
    messages = []
    for name in ("Frames", "Diagnostic_frames"):
        for x in blocks.get(name, []):
            if not isinstance(x, tuple):
                continue
            head = _fields(x[0])
            signals = []
            for y in x[1]:
                w = _fields(y)
                e = scales.get(encoding.get(w[0], ""), {})
                if w[0] not in sizes:
                    raise DatabaseError(f"frame {head[0]} names the unknown signal {w[0]}")
                signals.append(SignalDef(w[0], _number(w[1]), sizes[w[0]], False, e.get("signed", False), e.get("factor", 1.0), e.get("offset", 0.0), e.get("unit", ""), Mux(), tuple(e.get("labels", ()))))
            length = _number(head[-1]) if name == "Frames" and len(head) > 3 else 8
            messages.append(MessageDef(head[0], _number(head[1]) & 0x3F, False, length, tuple(signals)))
    return Database(tuple(messages))


# -- ARXML -------------------------------------------------------------------------------------------


class _Autosar:
    """The elements of a document by path, without namespaces."""

    def __init__(self, text: str | bytes) -> None:
        try:
            self.root = ET.fromstring(text)
        except ET.ParseError as e:
            raise DatabaseError(f"the description is no XML: {e}") from e
        for e in self.root.iter():
            e.tag = e.tag.rpartition("}")[2]
        self.by_path: dict[str, ET.Element] = {}
        self._enter(self.root, "")

    def _enter(self, e: ET.Element, path: str) -> None:
        name = e.findtext("SHORT-NAME")
        here = f"{path}/{name}" if name else path
        if name:
            self.by_path[here] = e
        for child in e:
            self._enter(child, here)

    def follow(self, e: ET.Element | None, tag: str) -> ET.Element | None:
        ref = None if e is None else e.find(f".//{tag}") if e.find(tag) is None else e.find(tag)
        return None if ref is None or not ref.text else self.by_path.get(ref.text.strip())


def _whole(e: ET.Element | None, tag: str) -> int | None:
    text = None if e is None else e.findtext(tag)
    try:
        return None if text is None else int(text.strip(), 0)
    except ValueError:
        return None


def _scale(doc: _Autosar, method: ET.Element | None) -> tuple[float, float, str, tuple]:
    """(factor, offset, unit, labels) of a computation method; text scales up to 1000 wide are spelt out."""
    if method is None:
        return 1.0, 0.0, "", ()
    unit_element = doc.follow(method, "UNIT-REF")
    unit = "" if unit_element is None else unit_element.findtext("DISPLAY-NAME") or unit_element.findtext("SHORT-NAME") or ""
    factor, offset, scaled = 1.0, 0.0, False
    labels: dict[int, str] = {}
    for s in method.iter("COMPU-SCALE"):
        top = [float(v.text) for v in s.findall(".//COMPU-NUMERATOR/V")]
        low = [float(v.text) for v in s.findall(".//COMPU-DENOMINATOR/V")]
        if top and low and not scaled:
            if low[0] == 0:
                return 1.0, 0.0, "", ()
            offset, factor = top[0] / low[0], (top[1] / low[0] if len(top) > 1 else 0.0)
            scaled = True
        text = s.findtext("COMPU-CONST/VT")
        if text is not None:
            lo = int(float(s.findtext("LOWER-LIMIT") or 0))
            hi = int(float(s.findtext("UPPER-LIMIT") or lo))
            for v in range(lo, hi + 1) if 0 <= hi - lo <= 1_000 else (lo,):
                labels[v] = text
    return factor, offset, unit, tuple(labels.items())


def parse_arxml(text: str | bytes) -> Database:
    """CAN clusters of an AUTOSAR description: frame, PDU, signal, computation method."""
    doc = _Autosar(text)
    messages = []

    def signal(mapping: ET.Element, mux: Mux) -> SignalDef | None:
        start, s = _whole(mapping, "START-POSITION"), doc.follow(mapping, "I-SIGNAL-REF")
        if start is None or s is None:
            return None
        represented, system = s.find("NETWORK-REPRESENTATION-PROPS"), doc.follow(s, "SYSTEM-SIGNAL-REF")
        base = doc.follow(represented, "BASE-TYPE-REF")
        signed = base is not None and (base.findtext(".//BASE-TYPE-ENCODING") or "").upper() == "2C"
        method = doc.follow(None if system is None else system.find("PHYSICAL-PROPS"), "COMPU-METHOD-REF")
        method = doc.follow(represented, "COMPU-METHOD-REF") if method is None else method
        factor, offset, unit, labels = _scale(doc, method)
        big = mapping.findtext("PACKING-BYTE-ORDER") == "MOST-SIGNIFICANT-BYTE-FIRST"
        return SignalDef(s.findtext("SHORT-NAME") or "", max(0, start), max(0, _whole(s, "LENGTH") or 0), big, signed, factor, offset, unit, mux, labels)

    def gather(pdu: ET.Element | None, out: list[SignalDef], mux: Mux = Mux(), selector: tuple[int, int] | None = None) -> None:
        if pdu is None:
            return
        if pdu.tag == "MULTIPLEXED-I-PDU":
            start, size = _whole(pdu, "SELECTOR-FIELD-START-POSITION"), _whole(pdu, "SELECTOR-FIELD-LENGTH")
            at = None if start is None or size is None else (max(0, start), max(0, size))
            for part in pdu.findall("STATIC-PARTS/*"):
                gather(doc.follow(part, "I-PDU-REF"), out, Mux(), at)
            for alternative in pdu.findall("DYNAMIC-PARTS/*/DYNAMIC-PART-ALTERNATIVES/*"):
                gather(doc.follow(alternative, "I-PDU-REF"), out, Mux("selected", _whole(alternative, "SELECTOR-FIELD-CODE") or 0), at)
            if at and at[1] and not any(s.mux.kind == "switch" for s in out):
                big = pdu.findtext("SELECTOR-FIELD-BYTE-ORDER") == "MOST-SIGNIFICANT-BYTE-FIRST"
                out.append(SignalDef(f"{pdu.findtext('SHORT-NAME') or 'Multiplexed'}_Selector", at[0], at[1], big, mux=Mux("switch")))
            return
        if pdu.tag == "CONTAINER-I-PDU":
            for ref in pdu.findall("CONTAINED-PDU-TRIGGERING-REFS/*"):
                triggering = doc.by_path.get((ref.text or "").strip())
                gather(doc.follow(triggering, "I-PDU-REF"), out)
            return
        for mapping in pdu.findall("I-SIGNAL-TO-PDU-MAPPINGS/I-SIGNAL-TO-I-PDU-MAPPING"):
            s = signal(mapping, mux)
            if s is None:
                continue
            if selector and (s.start_bit, s.size) == selector:
                if any(x.mux.kind == "switch" and x.start_bit == s.start_bit for x in out):
                    continue
                s = replace(s, mux=Mux("switch"))
            out.append(s)

    for triggering in doc.root.iter("CAN-FRAME-TRIGGERING"):
        frame, can_id = doc.follow(triggering, "FRAME-REF"), _whole(triggering, "IDENTIFIER")
        if frame is None or can_id is None:
            continue
        signals: list[SignalDef] = []
        for mapping in frame.iter("PDU-TO-FRAME-MAPPING"):
            gather(doc.follow(mapping, "PDU-REF"), signals)
        extended = triggering.findtext("CAN-ADDRESSING-MODE") == "EXTENDED"
        messages.append(MessageDef(frame.findtext("SHORT-NAME") or "", can_id & ID_MASK, extended, _whole(frame, "FRAME-LENGTH") or 0, tuple(signals)))
    return Database(tuple(messages))


def load_database(path: str) -> Database:
    """A database file by its ending: .dbc, .ldf or .arxml."""
    with open(path, "rb") as f:
        raw = f.read()
    ending = path.rsplit(".", 1)[-1].lower()
    parsers = {"dbc": parse_dbc, "ldf": parse_ldf, "arxml": parse_arxml}
    if ending not in parsers:
        raise DatabaseError(f"unknown database ending .{ending}")
    return parsers[ending](raw)


def raw_value(payload: bytes, s: SignalDef) -> int | None:
    """A signal's unsigned raw value in one payload."""
    if not 1 <= s.size <= 64:
        return None
    n = len(payload)
    if s.big_endian:
        first = s.start_bit // 8 * 8 + 7 - s.start_bit % 8
        last = first + s.size - 1
        if last // 8 >= n:
            return None
        whole, shift = int.from_bytes(payload[: last // 8 + 1], "big"), 7 - last % 8
    else:
        if (s.start_bit + s.size - 1) // 8 >= n:
            return None
        whole, shift = int.from_bytes(payload, "little"), s.start_bit
    return whole >> shift & ((1 << s.size) - 1)


def decode(db: Database, can_id: int, payload: bytes) -> list[tuple[str, float, str, str | None]]:
    """(signal, value, unit, label) of one frame; an unknown id gives none."""
    i = db.find(can_id)
    if i is None:
        return []
    message = db.messages[i]
    out = []
    for s in message.signals:
        raw = raw_value(payload, s) if selected(message, s, lambda x: raw_value(payload, x)) else None
        if raw is not None:
            n = raw - (1 << s.size) if s.signed and raw >> (s.size - 1) else raw
            out.append((s.name, n * s.factor + s.offset, s.unit, dict(s.labels).get(n)))
    return out


def selected(message: MessageDef, s: SignalDef, raw, path: Sequence[str] = ()) -> bool:
    """Whether a signal is present: every multiplexor above it is, and has a value that selects it."""
    if s.name in path or len(path) > MAX_MUX_DEPTH:
        return False
    if s.mux.kind in ("none", "switch"):
        return True
    if s.mux.kind == "selected":
        above = next((x for x in message.signals if x.mux.kind == "switch"), None)
        fits = lambda v: v == s.mux.value
    else:
        above = next((x for x in message.signals if x.name == s.mux.multiplexor), None)
        fits = lambda v: any(a <= v <= b for a, b in s.mux.ranges)
    if above is None or not selected(message, above, raw, (*path, s.name)):
        return False
    value = raw(above)
    return value is not None and fits(value)
