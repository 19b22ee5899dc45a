"""The sender's own new text of a raw message.

Reads headers and MIME parts leniently (mixed line ends, folded or oddly spelt headers, missing or
unclosed boundaries, wrong charsets, broken encodings), takes the readable body, and drops what the sender
did not write for this message: quoted and forwarded text, attributions, signatures and disclaimers.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

DEEPEST = 100  # multiparts within each other that are taken apart
_BREAK = re.compile(r"\r\n?")
_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*)[ \t]*:[ \t]*(.*)", re.S)
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]+)"|([^\s;]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([^\s";]+)', re.I)
_TAG_BREAK = re.compile(r"<\s*(?:br|/p|/div|/tr|/li|/h\d|hr)\b[^>]*>", re.I)
_TAG_DROP = re.compile(r"<\s*(style|script|head|blockquote)\b.*?<\s*/\s*\1\s*>", re.I | re.S)
_LINE = re.compile(r"\s*\n\s*")
_TAG = re.compile(r"<[^<>]*>")


def split_headers(text: str) -> tuple[dict[str, str], str]:
    """Headers by lower-case name (the first of each), and the body. A text whose first line is no header
    is all body."""
    headers: dict[str, str] = {}
    at, name, first = 0, "", True
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if not line:
            return headers, text[end + 1 :]
        if line[0] in " \t" and not first:
            if name:
                headers[name] += " " + line.strip()
        elif m := _HEADER.match(line):
            key = m[1].lower()
            name = "" if key in headers else key
            if name:
                headers[name] = m[2].strip()
        elif line.strip() and not line.startswith("From "):  # mailbox separators and damaged folds are skipped
            return headers, text[at:]
        first = False
        if end == len(text):
            return headers, ""
        at = end + 1
    return headers, ""


def _readable(raw: bytes, charset: str) -> str:
    for name in ("utf-8", charset, "latin-1"):
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


def _decoded(body: str, encoding: str, charset: str) -> str:
    encoding = encoding.strip().lower()
    if encoding == "quoted-printable":
        return _readable(quopri.decodestring(body.encode("utf-8", "replace")), charset)
    if encoding == "base64":
        kept = re.sub(r"[^A-Za-z0-9+/]", "", body)
        kept = kept[: len(kept) - (len(kept) % 4 == 1)]
        try:
            return _readable(base64.b64decode(kept + "=" * (-len(kept) % 4)), charset)
        except (binascii.Error, ValueError):
            return ""
    return body


def _plain(markup: str) -> str:
    text = _LINE.sub(" ", _TAG_DROP.sub("<br>", markup))  # lines of the source mean nothing
    text = _TAG_BREAK.sub("\n", text)
    return html.unescape(_TAG.sub("", text))


def _parts(body: str, boundary: str) -> list[str]:
    """Texts between boundary lines; what precedes the first is no part, a missing end ends with the text."""
    mark = "--" + boundary
    parts, current = [], None
    for line in body.split("\n"):
        bare = line.rstrip()
        if bare == mark or bare == mark + "--":
            if current is not None:
                parts.append("\n".join(current))
            current = [] if bare == mark else None
        elif current is not None:
            current.append(line)
    if current:
        parts.append("\n".join(current))
    return parts


def bodies(text: str, depth: int = 0) -> list[tuple[str, str]]:
    """(kind, text) of the readable parts of a message or part, kind plain or html. A multipart within DEEPEST
    others is plain text as it stands."""
    headers, body = split_headers(text)
    kind = headers.get("content-type", "text/plain").lower()
    if "attachment" in headers.get("content-disposition", "").lower() or "name=" in kind.replace("filename=", "name="):
        return []
    if kind.startswith("multipart/") and depth >= DEEPEST:
        return [("plain", body)]
    if kind.startswith("multipart/"):
        m = _BOUNDARY.search(headers["content-type"])
        boundary = (m[1] or m[2]) if m else None
        parts = _parts(body, boundary) if boundary else []
        if not parts:  # damaged: find a line that looks like a boundary
            if guess := re.search(r"^--(\S.*?)[ \t]*\n(?=content-)", body, re.I | re.M):
                parts = _parts(body, guess[1])
        if not parts:
            return [("plain", body)]
        inner = [bodies(p, depth + 1) for p in parts]
        if "alternative" in kind:  # one content in several forms: the plain one, or else the last
            plain = [x for x in inner if any(k == "plain" and t.strip() for k, t in x)]
            some = [x for x in inner if x]
            return plain[0] if plain else some[-1] if some else []
        return [b for x in inner for b in x]
    if kind.startswith("text/") or "/" not in kind:
        m = _CHARSET.search(kind)
        decoded = _decoded(body, headers.get("content-transfer-encoding", ""), m[1] if m else "utf-8")
        return [("html", _plain(decoded))] if "html" in kind else [("plain", decoded)]
    return []


# Lines that the sender did not write, or that end what they wrote: fixed values of mail conventions.
_QUOTED = re.compile(r"\s*[A-Z]{0,4}[>|]")
_SIGNATURE = re.compile(r"\s*--\s*$")
_RULE = re.compile(r"\s*(?:-{3,}|_{3,}|\*{3,}|={3,}|#{3,})\s*$")
_FORWARDED = re.compile(r"\s*-{2,}\s*\w[^\n]*\w\s*-{2,}\s*$")
_ORIGINAL = re.compile(r"\s*\w+\s?:\s.*[<@]")


def _ends(line: str) -> bool:
    return bool(_SIGNATURE.match(line) or _FORWARDED.match(line))


def _after_rule(lines: list[str], at: int) -> int | None:
    """Where own text goes on after a rule at a place: None if nothing follows but an original message; the end
    of the paragraph if there is one only (a footer: disclaimers stand so); else the next line."""
    first = next((i for i in range(at + 1, len(lines)) if lines[i].strip()), None)
    if first is None or _ORIGINAL.match(lines[first]):
        return None
    paragraphs, last, i = 0, "", first
    end = len(lines)
    while i < len(lines) and not _ends(lines[i]) and not _RULE.match(lines[i]):
        line = "" if _QUOTED.match(lines[i]) else lines[i].strip()
        if last and not line:
            paragraphs += not last.endswith(":")  # a line that introduces a quotation is none
            end = min(end, i)
        last = line
        i += 1
    if last:
        paragraphs += not last.endswith(":")
        end = min(end, i)
    return end if paragraphs <= 1 else at + 1


def _own_lines(lines: list[str]) -> list[str]:
    kept: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if _QUOTED.match(line):
            i += 1
        elif _ends(line):
            break
        elif _RULE.match(line) and not (i and lines[i - 1].strip()):
            go_on = _after_rule(lines, i)
            if go_on is None:
                break
            i = go_on
        else:
            kept.append(line)
            i += 1
    return kept


def own_text(message: str | None) -> str:
    """What the sender wrote, part by part: lines up to a signature or forwarded message, without quoted lines
    and footers. A footer is a single last paragraph after a rule that stands apart; a rule under a line of
    text, or with more paragraphs after it, divides text only. Lines of attribution stay, since they hold
    names and dates only."""
    return "\n".join(line for text in _texts(message) for line in _own_lines(text.split("\n")))


def _texts(message: str | None) -> list[str]:
    if not message:
        return []
    return [_BREAK.sub("\n", t) for _, t in bodies(_BREAK.sub("\n", message).lstrip("\ufeff\n"))]


def body_text(message: str | None) -> str:
    """The message's readable text, with newlines between lines; empty for null and empty messages."""
    return "\n".join(_texts(message))
