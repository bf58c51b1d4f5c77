"""Mail: mbox, emlx and single messages, with attachments as documents of their own."""

from __future__ import annotations

import email
import re
from collections.abc import Callable
from email import policy
from email.message import EmailMessage

from loregrid.functions.text import MASKS
from loregrid.sources.attachments import Budget, expanded
from loregrid.sources.base import Parsed
from loregrid.sources.html import visible_text

LIMIT, BODY, ATTACHMENT, DEPTH = 64 << 20, 1 << 20, 16 << 20, 16


def messages(path: str, data: bytes) -> list[EmailMessage]:
    if path.lower().endswith(".emlx"):  # a count, the message of so many bytes, a property list
        count, _, rest = data.partition(b"\n")
        parts = [rest[: int(count)] if count.strip().isdigit() else rest]
    elif data.startswith(b"From "):
        parts = [p.partition(b"\n")[2] for p in re.split(rb"(?m)^(?=From )", data) if p.strip()]
    else:
        parts = [data]
    return [email.message_from_bytes(p, policy=policy.default) for p in parts]


def leaves(message: EmailMessage, depth: int = 0):
    if depth > DEPTH:
        return
    if message.is_multipart():
        for p in message.iter_parts():
            yield from leaves(p, depth + 1)
    else:
        yield message


def body_of(message: EmailMessage) -> str:
    """The plain text of a message, else its HTML's text; at most ``BODY`` bytes."""
    texts: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in leaves(message):
        if part.get_content_type() in texts and part.get_content_disposition() != "attachment":
            raw = (part.get_payload(decode=True) or b"")[:BODY]
            texts[part.get_content_type()].append(raw.decode(part.get_content_charset() or "utf-8", "replace"))
    plain = "\n".join(texts["text/plain"]).strip()
    return plain or visible_text("\n".join(texts["text/html"]))[1]


def masked(text: str) -> str:
    for pattern, to in MASKS:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), text)
    return text


def parse(path: str, data: bytes, attachment_limit: int = ATTACHMENT, readers: dict[str, Callable[[str, bytes], list[Parsed]]] | None = None, budget: Budget | None = None) -> list[Parsed]:
    """The thread as one document, its bodies masked and parted by lines, and one for each attachment that can be read.

    Archives give what they hold, also in archives inside them, under one budget for the whole file. Attachments
    that are too large or fail are named in the metadata.
    """
    readers = {".txt": _text, ".md": _text, ".csv": _text} | (readers or {})
    found, budget = messages(path, data), budget or Budget()
    bodies, children, names, failures = [], [], set(), []
    for n, m in enumerate(found):
        bodies.append(masked(body_of(m)))
        for part in leaves(m):
            name = part.get_filename()
            if not name:
                continue
            names.add(name)
            raw = part.get_payload(decode=True) or b""
            if len(raw) > attachment_limit:
                failures.append(f"{name}: larger than {attachment_limit} bytes")
                continue
            files, failed = expanded(name, raw, budget)
            failures += failed
            for own, data in files:
                reader = readers.get("." + own.rsplit(".", 1)[-1].lower())
                if not reader:
                    continue
                try:
                    for c in reader(own, data):
                        children.append(Parsed(c.title or own, masked(c.content), {"attachment": own, **c.metadata}, ("attachment", str(n), own, *c.parts)))
                except Exception as e:  # the message itself is still good
                    failures.append(f"{own}: {e}")
    first = found[0] if found else EmailMessage()
    head = {k: masked(str(first.get(h, ""))) for k, h in (("from", "From"), ("to", "To"), ("date", "Date")) if first.get(h)}
    meta = {**head, **({"attachments": ",".join(sorted(names))} if names else {}), **({"attachment_failures": "; ".join(failures)} if failures else {})}
    return [Parsed(str(first.get("Subject", "")) or path.rsplit("/", 1)[-1], "\n\n---\n\n".join(b for b in bodies if b), meta), *children]


def _text(name: str, raw: bytes) -> list[Parsed]:
    return [Parsed(name, raw.decode("utf-8", "replace"))]
