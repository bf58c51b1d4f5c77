"""Chat formatting with typed content parts.

A visitor flattens text, image, audio and document parts into one text per turn: a part that is not text
becomes a numbered placeholder, and its reference and expanded token count are recorded. The template
marks turns; control strings inside texts are escaped so that the output can be read back, and neighbouring
text parts are one text before that.

Defined results: a null text is empty; a null role is the empty role; turns are ordered by (turn, role,
text), nulls first, and repeated rows are repeated turns; a null conversation id is a conversation like
any other; other columns are ignored; an empty table gives no rows. A conversation is one output text and
so is formatted in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = "formatted string, n_turns long, loss array<struct<start:long,end:long>>, attachments array<struct<turn:long,placeholder:string,kind:string,ref:string,tokens:long>>"


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, visitor: Flattener) -> str:
        return visitor.text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0

    def accept(self, visitor: Flattener) -> str:
        return visitor.image(self)


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = 0.0

    def accept(self, visitor: Flattener) -> str:
        return visitor.audio(self)


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 0

    def accept(self, visitor: Flattener) -> str:
        return visitor.document(self)


@dataclass
class Flattener:
    """The visitor: returns the flat text of each part in order and records attachments.

    Expanded tokens: an image has one for each started patch of ``patch`` by ``patch`` pixels, audio
    ``per_second`` for each started second, a document ``per_page`` for each page; one at least.
    """

    patch: int = 28
    per_second: int = 25
    per_page: int = 256
    attachments: list[dict] = field(default_factory=list)

    def text(self, part: Text) -> str:
        return escape(part.text)

    def image(self, part: Image) -> str:
        return self._place("image", part.ref, -(-part.width // self.patch) * -(-part.height // self.patch))

    def audio(self, part: Audio) -> str:
        return self._place("audio", part.ref, int(-(-part.seconds // 1)) * self.per_second)

    def document(self, part: Document) -> str:
        return self._place("document", part.ref, part.pages * self.per_page)

    def _place(self, kind: str, ref: str, tokens: int) -> str:
        mark = f"<|{kind}_{len(self.attachments) + 1}|>"
        self.attachments.append({"placeholder": mark, "kind": kind, "ref": ref, "tokens": max(1, tokens)})
        return mark


def escape(text: str) -> str:
    """No control string is left: a backslash is doubled and parts ``<`` from ``|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], role)


def parts_of(text: str | None, parts: list[dict] | None) -> list:
    """The typed parts of a row: its text, if any, then its parts; an unknown kind is text, and so is one without kind."""
    out: list = [Text(text)] if text else []
    for p in parts or []:
        if p is None:
            continue
        ref = p.get("ref") or ""
        if p.get("kind") == "image":
            out.append(Image(ref, p.get("width") or 0, p.get("height") or 0))
        elif p.get("kind") == "audio":
            out.append(Audio(ref, p.get("seconds") or 0.0))
        elif p.get("kind") == "document":
            out.append(Document(ref, p.get("pages") or 0))
        else:
            out.append(Text(p.get("text") or ""))
    return out


def joined(parts: list) -> list:
    """Neighbouring texts as one, so that no control string arises where two of them meet."""
    out: list = []
    for p in parts:
        if isinstance(p, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + p.text)
        elif not isinstance(p, Text) or p.text:
            out.append(p)
    return out


def format_turns(turns: list[tuple[str, list]], learn: str = "assistant") -> dict:
    """One conversation; ``loss`` has the code points of each ``learn`` turn's text in ``formatted``."""
    visitor, out, at, loss, where = Flattener(), [], 0, [], []
    for n, (role, parts) in enumerate(turns):
        seen = len(visitor.attachments)
        head, body = f"{START}{escape_role(role)}\n", "".join(p.accept(visitor) for p in joined(parts))
        where += [n] * (len(visitor.attachments) - seen)
        if role == learn:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    attachments = [{"turn": n, **a} for n, a in zip(where, visitor.attachments, strict=True)]
    return {"formatted": "".join(out), "n_turns": len(turns), "loss": loss, "attachments": attachments}


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; placeholders stay as they are."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def format_chats(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """(conv, formatted, n_turns, loss, attachments): a row for each conversation; ``parts`` names a column of typed parts."""
    given = (F.col(parts) if parts else F.lit(None)).cast(PARTS)
    one = F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), given.alias("parts"))
    grouped = chats.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    kind = chats.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turns([(t["role"] or "", parts_of(t["text"], t["parts"])) for t in turns]) for turns in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"conv": b.column(0), **{k: pa.array([m[k] for m in made], t) for k, t in _ARROW.items()}}
            )

    return grouped.mapInArrow(run, f"conv {kind}, {FORMATTED}").withColumnRenamed("conv", conv)


_ARROW = {
    "formatted": pa.string(),
    "n_turns": pa.int64(),
    "loss": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    "attachments": pa.list_(pa.struct([("turn", pa.int64()), ("placeholder", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])),
}


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the formatted text: counts and digests of turns and of the text under the loss mask."""
    import hashlib

    kind = formatted.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), digest(learnt), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(F.col(conv).alias("conv"), "formatted", "loss").mapInArrow(
        run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ).withColumnRenamed("conv", conv)
