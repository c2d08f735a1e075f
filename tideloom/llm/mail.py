"""Problem 5: reducing mails to the lines newly written by their sender.

Threads are rebuilt from list-independent subjects (the messages carry no reference headers) and dates. Messages are compared
with their thread by rolling-hash shingles of words: each shingle of a message names the nearest earlier message that has it, and
its place there. Matches with one message on one diagonal (place here less place there) are chained over small gaps, which
aligns the two word sequences without any body leaving its row; long chains mark inherited spans, which also ends quoted
blocks that carry no marks. Standing matter - closings with a name, signatures, device notes, footers, legal notices - is learned
from repetition: paragraphs that many messages have, and that stand at the end of what their senders wrote. What is left is
cut at introductions and signatures by their form; short lists of formulas serve where nothing was seen often enough.
"""

from __future__ import annotations

import email.header
import email.utils
import hashlib
import quopri
import re
import zlib
from collections.abc import Iterator
from datetime import timezone

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.session import materialise

#: Words in a shingle; places between two matches that a chain bridges; words of a chain that end a quoted block; of one that is inherited wherever it stands.
SHINGLE, GAP, RUN, SURE = 8, 8, 10, 20
#: Threads of more than 1/HOT_SHARE of all messages, and more than HOT_LEAST, are cut into days; at most HOT_SHARE can be hot.
HOT_SHARE, HOT_LEAST, DAY = 500, 50_000, 86_400

#: Messages a paragraph must stand in to be learned; its least share at the end of a text, among the last TAIL paragraphs; its greatest share at the start.
SEEN, AT_END, TAIL, AT_START = 6, 0.9, 3, 0.3

# Reply and forward prefixes, closing formulas, and marks of device notes, footers and legal notices.
_PREFIX = re.compile(r"^\s*(?:\[[^\]]{1,40}\]|(?:re|aw|antw|antwort|sv|vs|vb|fwd?|fw|wg|tr|rv|rif|res|enc|odp|doorst)\s*(?:\[\d+\]|\^\d+|\(\d+\))?\s*[:：])\s*", re.I)
_CLOSING = re.compile(
    r"^(?:(?:with )?(?:best|kind|warm|kindest|warmest|many)?\s*(?:regards|wishes|thanks)|all the best|best|thanks(?: a lot| again)?|thank you|cheers|yours(?: sincerely| truly| faithfully)?|sincerely(?: yours)?|warmly|take care|see you"
    r"|mit (?:freundlichen|besten|herzlichen) gr(?:ü|ue)(?:ß|ss)en|(?:viele|liebe|beste|schöne|herzliche|freundliche) gr(?:ü|ue)(?:ß|ss)e|(?:gruß|grüße|mfg|lg|vg|danke)|tschüss"
    r"|cordialement|bien (?:à vous|cordialement)|amicalement|amitiés|cordiales salutations|salutations|meilleures salutations|merci|à bientôt"
    r"|(?:un )?(?:cordial )?saludos?(?: cordiales)?|un (?:abrazo|saludo)|atentamente|gracias|cordialmente|(?:um )?abraços?|atenciosamente|cumprimentos|obrigad[oa]|saudações"
    r"|met vriendelijke groet(?:en)?|groet(?:en|jes)?|mvg|hartelijke groet(?:en)?|bedankt|vriendelijke groeten|cordiali saluti|saluti|distinti saluti|grazie|un saluto"
    r"|(?:med )?vänliga hälsningar|hälsningar|mvh|tack|pozdrawiam|pozdrowienia|z poważaniem|med venlig hilsen|venlig hilsen|hilsen)\s*[,.!]*$",
    re.I,
)
_DEVICE = re.compile(
    r"^(?:sent (?:from|via|with|by) |von mein\w+ .{2,40}gesendet|gesendet (?:von|mit)|diese nachricht wurde von mein|envoyé (?:depuis|de) mon|enviado (?:desde|do) (?:mi|meu)|enviado (?:desde|do|pelo)|inviato da|verzonden (?:vanaf|met|van)|verstuurd|skickat från|wysłane z|sendt fra|get (?:the )?.{0,40}\b(?:app|outlook)\b)",
    re.I,
)
_FOOTER = re.compile(r"mailing list\b|mailing-list|\bunsubscribe\b|\bto leave,? write|you (?:get|receive|are receiving) this (?:because|mail|message)|https?://lists\.|\blists?\.[\w.-]+/|-(?:leave|off|unsubscribe|request)@|\| archive:|abbestellen|désabonner|désinscri", re.I)
_LEGAL = re.compile(
    r"confidential|disclaimer|privileged|intended (?:only|solely)|meant only for|named (?:recipient|above)|vertraulich|genannten empfänger|confidentiel|réservé à son destinataire|información reservada|confidencial|destinatari|riservat|vertrouwelijk|geadresseerde|konfidentiell|poufn\w+|accepts no liability|checked for viruses|registered office|do not bind|before printing|register no|\be\.v\.,",
    re.I,
)
_POSTSCRIPT = re.compile(r"^(?:p\.?\s?s\b|p\.p\.s|nb\b|n\.b\.|one more thing|nachtrag|post ?scriptum|posdata|p\.?\s?d\b)", re.I)
_RULER = re.compile(r"^\s*(?:[-_=*~#+.–—]\s?){2,}\s*$")
_QUOTE = re.compile(r"^\s{0,8}(?:[>|»:¦]|[A-ZÄÖÜ][A-Za-zÄÖÜ]{0,3}>)")
_HEADER = re.compile(r"^\s*\*{0,2}(from|to|cc|bcc|date|sent|subject|reply-to|von|an|datum|gesendet|betreff|kopie|de|à|a|pour|envoyé|objet|date|para|enviado(?: el)?|enviada em|asunto|assunto|fecha|data|da|inviato|oggetto|van|aan|verzonden|onderwerp|från|till|skickat|ämne|fra|til|emne|od|do|temat)\*{0,2}\s?:\*{0,2}\s", re.I)
_FORWARD = re.compile(r"^\s*(?:-{2,}\s*[^-]{4,60}\s*-{2,}|begin forwarded message:|anfang der weitergeleiteten (?:nachricht|e-mail):|début du message (?:réexpédié|transféré)\s*:|inicio del mensaje reenviado:)\s*$", re.I)
_VERB = re.compile(r"\b(?:wrote|writes?|said|says|schrieb|schreibt|geschrieben|a écrit|écrit|escribió|escribe|escreveu|schreef|schrijft|skrev|skriver|napisał(?:a)?|ha scritto|scrive|quoting|citando|zitat)\b", re.I)
_DATE = re.compile(r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b(?:19|20)\d\d\b|\b\d{1,2}:\d{2}\b|\b[A-Z]\w+ \d{1,2}\b|<[^<>@\s]+@[^<>\s]+>|\S+@\S+")
_WORD = re.compile(r"[^\W_]+")
_NEVER = re.compile(r"(?!)")


def decode_header(s: str | None) -> str:
    try:
        return "".join(p.decode(c or "latin-1", "replace") if isinstance(p, bytes) else p for p, c in email.header.decode_header(s or ""))
    except (LookupError, ValueError, email.errors.HeaderParseError):
        return s or ""


def thread_subject(s: str | None) -> str:
    """The subject without list tags and reply prefixes, in one notation; empty for none."""
    t = decode_header(s).replace("_", " ")
    while True:
        u = _PREFIX.sub("", t, count=1)
        if u == t:
            return " ".join(_WORD.findall(t.lower()))
        t = u


def sent_at(s: str | None) -> int | None:
    try:
        d = email.utils.parsedate_to_datetime(s)
        return int((d if d.tzinfo else d.replace(tzinfo=timezone.utc)).timestamp())
    except (TypeError, ValueError, IndexError, OverflowError):
        return None


def logical_lines(body: str) -> list[tuple[list[int], str]]:
    """(stored line numbers, decoded text): soft line breaks of the transfer encoding join, stray carriage returns go."""
    raw = [x.rstrip("\r") for x in body.split("\n")]
    coded = bool(re.search(r"=[0-9A-F]{2}", body)) and (any(x.endswith("=") for x in raw) or bool(re.search(r"=(?:20|3D|C[23]|E2)", body)))
    out: list[tuple[list[int], str]] = []
    open_ = False
    for no, x in enumerate(raw, 1):
        soft = coded and x.endswith("=") and not re.fullmatch(r"\s*(?:=\s?){2,}", x)
        text = x[:-1] if soft else x
        if open_:
            out[-1][0].append(no)
            out[-1] = (out[-1][0], out[-1][1] + text)
        else:
            out.append(([no], text))
        open_ = soft
    if coded:
        out = [(n, quopri.decodestring(t.encode("utf-8", "replace")).decode("utf-8", "replace") if "=" in t else t) for n, t in out]
    return [(n, t.replace("\r", "").replace("\xa0", " ")) for n, t in out]


def strip_marks(t: str) -> str:
    while m := _QUOTE.match(t):
        t = t[m.end() :]
    return t


def words(body: str | None) -> list[str]:
    """Words of the whole decoded body, quote marks aside, in lower case."""
    return [w for _, t in logical_lines(body or "") for w in _WORD.findall(strip_marks(t).lower())]


def rolling(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of k words: a polynomial over word hashes, rolled in one pass."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]  # of no runs nothing
    return out.astype(np.int64)


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in ws], np.uint64)


def thread_grams(ws: list[str], thread: str) -> np.ndarray:
    """Rolling hashes of the words, mixed with the thread."""
    salt = np.uint64(int.from_bytes(hashlib.blake2b(thread.encode("utf-8", "replace"), digest_size=8).digest(), "little") | 1)
    with np.errstate(over="ignore"):
        return ((rolling(word_hashes(ws)).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + salt) * salt).astype(np.int64)


def inherited(n: int, grams: np.ndarray, h: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each of n words the length of the longest chain of at least RUN words it lies in, else 0.

    grams are the shingles of the words in order; h, owner and place tell for each shared shingle who had it, and where. Every
    match belongs to one chain and a chain is at most GAP times as long as its matches, so the work is in proportion to n.
    """
    hit = np.zeros(n, np.int64)
    if not len(grams) or not len(h):
        return hit
    order = np.argsort(h, kind="stable")
    h, owner, place = h[order], owner[order], place[order]
    at = np.minimum(np.searchsorted(h, grams), len(h) - 1)
    here = np.flatnonzero(h[at] == grams)
    who, diagonal = owner[at[here]], here - place[at[here]]
    order = np.lexsort((here, diagonal, who))
    here, who, diagonal = here[order], who[order], diagonal[order]
    first = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(diagonal) != 0) | (np.diff(here) > GAP)])[: len(here)]
    start, end = here[first], here[np.r_[first[1:], len(here)] - 1] + SHINGLE
    chain = np.zeros(len(grams), np.int64)
    for a, b in zip(start[end - start >= RUN], end[end - start >= RUN]):
        np.maximum(hit[a:b], b - a, out=hit[a:b])
        chain[a : b - SHINGLE + 1] = np.maximum(chain[a : b - SHINGLE + 1], b - a)
    # only first places are known: a shingle met again is as inherited as where it stood first
    _, first, again = np.unique(grams, return_index=True, return_inverse=True)
    chain = np.where(np.isin(grams, h), chain[first][again], 0)
    for k in range(SHINGLE):
        np.maximum(hit[k : k + len(chain)], chain, out=hit[k : k + len(chain)])
    return hit


def _name_words(sender: str | None) -> list[str]:
    """Words of the sender's name, else of the address."""
    name = decode_header(sender)
    return [w for w in _WORD.findall(re.sub(r"<[^>]*>", " ", name).lower()) if len(w) > 1] or _WORD.findall(name.split("@")[0].lower())


def standing_key(lines: list[str], tokens: list[str]) -> int:
    """Hash of a paragraph in a form all its occurrences share: words in lower case, the sender's name and digits aside."""
    own = set(tokens)
    initials = {w[0] for w in tokens}
    t = " ".join("*" if w in own or len(w) == 1 and w in initials else w for w in _WORD.findall(re.sub(r"\d+", "0", " ".join(lines).lower())))
    return xxhash.xxh64_intdigest(t) - (1 << 63) if t else 0


def paragraphs_of(text: list[str], quoted: list[bool]) -> list[list[tuple[int, int]]]:
    """Line ranges of the plain paragraphs, by stretches: a quotation or an introduction ends a stretch."""
    out: list[list[tuple[int, int]]] = [[]]
    k, n = 0, len(text)
    while k < n:
        if quoted[k]:
            if out[-1]:
                out.append([])
            k += 1
            continue
        e = k
        while e < n and not quoted[e] and text[e].strip():
            e += 1
        if e > k:
            first = text[k].strip()
            if _introduces(" ".join(x.strip() for x in text[k : min(e, k + 3)])) or _introduces(first) or _HEADER.match(first) or _FORWARD.match(first) and not _RULER.match(first):
                if out[-1]:
                    out.append([])
            else:
                out[-1].append((k, e))
        k = max(e, k + 1)
    return [x for x in out if x]


def _quoted(text: list[str]) -> list[bool]:
    # a mail program puts a mark before a line that starts with From; a smiley is no mark
    return [bool(_QUOTE.match(t)) and not re.match(r"^>From ", t) and not re.match(r"^\s*:[-)(DPp/]", t) for t in text]


def _introduces(text: str) -> bool:
    """Whether joined lines read like the introduction of a quotation."""
    t = text.strip()
    if len(t) > 220 or not t.endswith(":"):
        return False
    return bool(_VERB.search(t) and (_DATE.search(t) or len(t) < 70)) or bool(_DATE.search(t) and re.search(r"\[[^\]]*\d[^\]]*\]:$|@\S+>?:$", t))


def new_lines(body: str | None, sender: str | None, thread: str = "", shared: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, standing: set[int] = frozenset(), lists: bool = True) -> list[int]:
    """Numbers of the stored lines newly written by the sender. shared: the hashes, owners and places of shingles earlier messages of
    the thread have; standing: keys of paragraphs learned to be standing matter; lists: whether the lists of formulas are used too."""
    closing, device, footer, legal = (_CLOSING, _DEVICE, _FOOTER, _LEGAL) if lists else (_NEVER,) * 4
    if not body or not body.strip():
        return []
    lines = logical_lines(body)
    text = [t for _, t in lines]
    n = len(lines)
    blank = [not t.strip() for t in text]
    count = [len(_WORD.findall(t)) for t in text]
    quoted = _quoted(text)
    old = list(quoted)

    # where lines stand against blank and quoted ones
    nxt: list[int | None] = [None] * n
    prv: list[int] = [-1] * n  # -1: none before
    stop = [n] * (n + 1)
    for k in range(n - 2, -1, -1):
        nxt[k] = nxt[k + 1] if blank[k + 1] else k + 1
    for k in range(1, n):
        prv[k] = prv[k - 1] if blank[k - 1] else k - 1
    for k in range(n - 1, -1, -1):
        stop[k] = k if blank[k] or quoted[k] else stop[k + 1]

    # words of plain lines against the thread
    share, sure = [0.0] * n, [0.0] * n
    if shared is not None:
        ws, at = [], []
        for k in range(n):
            some = _WORD.findall(strip_marks(text[k]).lower())
            ws += some
            at += [k] * len(some)
        hit = inherited(len(ws), thread_grams(ws, thread), *shared)
        if at:
            total = np.maximum(1, np.bincount(at, minlength=n))
            share = (np.bincount(at, weights=hit > 0, minlength=n) / total).tolist()
            sure = (np.bincount(at, weights=hit >= SURE, minlength=n) / total).tolist()
    # paragraphs of plain lines: mostly inherited ones, then short ones that belong to them
    paragraphs: list[range] = []
    k = 0
    while k < n:
        e = k
        while e < n and not blank[e] and not quoted[e]:
            e += 1
        if e > k:
            paragraphs.append(range(k, e))
        k = max(e, k + 1)
    taken = []
    for par in paragraphs:
        size = [count[k] for k in par]
        got = sum(sure[k] * w for k, w in zip(par, size))
        taken.append(got >= 0.5 * max(1, sum(size)))
        for k in par:
            if taken[-1] or sure[k] >= 0.9 and count[k] >= 6:
                old[k] = True
    small = lambda par: len(par) <= 6 and all(len(text[k].strip()) <= 45 and not text[k].strip().endswith((".", "?", "!")) for k in par)
    for i in range(1, len(paragraphs)):
        if taken[i - 1] and not taken[i] and small(paragraphs[i]) and not any(quoted[paragraphs[i - 1][-1] + 1 : paragraphs[i][0]]):
            taken[i] = True
            for k in paragraphs[i]:
                old[k] = True
    for i in range(1, len(paragraphs) - 1):
        par = paragraphs[i]
        if taken[i + 1] and not taken[i] and len(par) == 1 and count[par[0]] <= 5 and text[par[0]].strip().endswith((",", ":", "!")) and not any(quoted[par[-1] : paragraphs[i + 1][0]]):
            old[par[0]] = True

    # wrapped remainders of quoted lines
    for k in range(1, n - 1):
        if not old[k] and not blank[k] and quoted[k - 1] and strip_marks(text[k - 1]).strip() and len(text[k]) < 45:
            before = strip_marks(text[k - 1]).strip()
            if before[-1] not in ".?!:" and len(before) > 25 and (quoted[k + 1] or blank[k + 1]) and (text[k][:1].islower() or quoted[k + 1]):
                old[k] = True

    # introductions of one to three lines
    intro = [False] * n
    k = 0
    while k < n:
        for width in (1, 2, 3):
            span = range(k, min(n, k + width))
            if len(span) < width or any(blank[j] for j in span) or (width > 1 and any(quoted[j] for j in span)):
                break
            joined = " ".join(text[j].strip() for j in span)
            if not quoted[k] and _introduces(joined) and (width == 1 or not text[k].strip().endswith((".", "?", "!"))):
                after = nxt[span[-1]]
                if (width == 1 or k == 0 or blank[k - 1] or old[k - 1]) or (after is not None and quoted[after]):
                    for j in span:
                        intro[j] = old[j] = True
                    break
        k += 1
    # an introduction whose sentence was too unusual: the line before a quotation ends with a colon and names a time or address
    for k in range(n):
        after = nxt[k]
        if not old[k] and not blank[k] and text[k].strip().endswith(":") and after is not None and quoted[after] and _DATE.search(text[k]):
            intro[k] = old[k] = True
            j = k - 1
            while j >= 0 and k - j <= 2 and not blank[j] and not old[j] and (j == 0 or blank[j - 1] or old[j - 1] or k - j == 1) and re.match(r"^\s*(?:on|am|le|el|em|op|den|il|w dniu|in|quoting|\*)\b", text[j], re.I):
                intro[j] = old[j] = True
                j -= 1

    # header blocks of forwarded or replied mail
    for k in range(n):
        if quoted[k] or blank[k]:
            continue
        if _FORWARD.match(text[k]) and not _RULER.match(text[k]):
            after = nxt[k]
            if after is not None and (_HEADER.match(strip_marks(text[after])) or quoted[after] or _introduces(text[after])):
                intro[k] = old[k] = True
        run = k
        while run < n and _HEADER.match(text[run]):
            run += 1
        if run - k >= 2 or (run - k == 1 and k and intro[k - 1]):
            for j in range(k, run):
                intro[j] = old[j] = True

    # what follows an introduction without marks: an indented block, or everything up to the end of what is inherited
    k = 0
    while k < n:
        if not intro[k]:
            k += 1
            continue
        last = k
        while last + 1 < n and (intro[last + 1]):
            last += 1
        first = nxt[last]
        k = last + 1
        if first is None or quoted[first] or intro[first]:
            continue
        if re.match(r"^(?: {3,}|\t)", text[first]):
            j = first
            while j < n and (blank[j] or re.match(r"^(?: {3,}|\t)", text[j]) or quoted[j]):
                old[j] = True
                j += 1
            k = j
            continue
        known = [j for j in range(first, n) if share[j] >= 0.7 and not quoted[j] and count[j] >= 3]
        end = n
        if known:
            # the ancestor tells where the block ends: after its last inherited line, its closing and name included
            end = known[-1] + 1
            while end < n and (blank[end] or len(text[end]) < 40 and not quoted[end] and (closing.match(text[end].strip()) or count[end] <= 3)):
                end += 1
        for j in range(first, end):
            old[j] = True
        k = end

    # tail and signatures
    tokens = _name_words(sender)
    learned = [False] * (n + 1)
    if standing:
        for stretch in paragraphs_of(text, quoted):
            for a, e in stretch:
                learned[a] = standing_key(text[a:e], tokens) in standing

    def is_name(t: str) -> bool:
        ws = _WORD.findall(t.lower())
        if not ws or len(ws) > 4 or len(t.strip()) > 40:
            return False
        return all(w in tokens for w in ws) or (len(ws) == 1 and len(ws[0]) == 1 and bool(tokens) and ws[0] == tokens[0][0]) or (len(ws) == 2 and all(any(x[0] == w[0] and (len(w) == 1 or w == x) for x in tokens) for w in ws) and len(ws[0]) + len(ws[1]) <= 2)

    known_tail: dict[int, bool] = {n: True}

    def tail(k: int) -> bool:
        """Whether nothing but standing matter follows the paragraph at k (a list footer or legal notice ends a mail or its new part)."""
        e, passed = k, []
        while e < n and not blank[e]:
            e += 1
        while e not in known_tail:
            passed.append(e)
            if blank[e] or old[e] or learned[e] or _RULER.match(text[e].strip()) or device.match(text[e].strip()):
                e += 1
                continue
            f = e
            while f < n and not blank[f]:
                f += 1
            block = " ".join(text[e:f])
            if not (footer.search(block) or legal.search(block) or _introduces(block)):
                known_tail[e] = False
                break
            e = f
        for x in passed:
            known_tail[x] = known_tail[e]
        return known_tail[e]

    signed = False
    for k in range(n):
        if quoted[k] or intro[k]:
            signed = False
        if old[k] or blank[k]:
            continue
        t = text[k].strip()
        ws = _WORD.findall(t)
        if signed and (blank[k - 1] or old[k - 1]) and not _POSTSCRIPT.match(t):
            # standing matter below the signature: only a postscript is new there
            e = stop[k]
            old[k:e] = [True] * (e - k)
            continue
        start = k == 0 or blank[k - 1] or old[k - 1]
        if learned[k] and prv[k] >= 0:
            e = stop[k]
            old[k:e] = [True] * (e - k)
            signed = True
            continue
        if re.fullmatch(r"--\s?", t) or t == "--":
            j = stop[k + 1]
            old[k:j] = [True] * (j - k)
            signed = True
        elif _RULER.match(t):
            j = nxt[k]
            if j is None or old[j] or is_name(text[j]):
                signed = signed or j is not None and is_name(text[j])
                e = stop[j] if j is not None and is_name(text[j]) else k + 1
                old[k:e] = [True] * (e - k)
            else:
                e = stop[j]
                block = " ".join(text[j:e])
                if footer.search(block) or legal.search(block) or device.match(text[j].strip()):
                    old[k:e] = [True] * (e - k)
        elif start and device.match(t) and len(t) < 120:
            old[k] = True
        elif start and (footer.search(block := " ".join(text[k : stop[k]])) or legal.search(block)) and tail(k):
            e = stop[k]
            old[k:e] = [True] * (e - k)
        elif is_name(t):
            # a name ends the text: with the lines of the signature below it, and a closing formula above
            j = prv[k]
            e = stop[k]
            old[k:e] = [True] * (e - k)
            signed = True
            if j >= 0 and not old[j] and (closing.match(text[j].strip()) or count[j] <= 4 and text[j].strip().endswith(",") and len(text[j].strip()) <= 32) and (j == 0 or blank[j - 1] or old[j - 1]) and prv[j] >= 0:
                old[j] = True
        elif closing.match(t) and len(ws) <= 5:
            j = nxt[k]
            if j is None or old[j] or is_name(text[j]) or _RULER.match(text[j]) or device.match(text[j].strip()):
                old[k] = True
    for k in range(n):  # closing formulas above what has become a footer only now
        j = nxt[k]
        if not old[k] and not blank[k] and closing.match(text[k].strip()) and len(text[k]) <= 40 and (j is None or old[j]) and (k == 0 or blank[k - 1] or old[k - 1]):
            old[k] = True
        elif not old[k] and not blank[k] and closing.match(text[k].strip()) and j == k + 1 and stop[k] == k + 2 and count[j] <= 3 and not text[j].strip().endswith((".", "?", "!")):
            old[k] = old[j] = True  # a name in a spelling of its own
    stored = body.split("\n")
    return [no for k, (nos, _) in enumerate(lines) if not old[k] and not blank[k] for no in nos if stored[no - 1].strip()]


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        at = pd.array([sent_at(s) for s in b["msg_date"]], "Int64")
        yield pd.DataFrame({"msg_id": b["msg_id"], "thread": [thread_subject(s) for s in b["subject"]], "at": at, "sender": b["sender"], "body": b["body"]})


def _shingles(hot: set[str]):
    """(msg_id, at, h, place, cell): each shingle of a message once, with its first place; cell is the day in hot threads, else 0."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for i, thread, at, body in zip(b["msg_id"], b["thread"], b["at"], b["body"]):
                h, place = np.unique(thread_grams(words(body), thread), return_index=True)
                if len(h):
                    parts.append((np.full(len(h), i, np.int64), np.full(len(h), at, np.int64), h, place.astype(np.int32), np.full(len(h), at // DAY + (1 << 40) if thread in hot else 0, np.int64)))
            if parts:
                yield pd.DataFrame(dict(zip(("msg_id", "at", "h", "place", "cell"), map(np.concatenate, zip(*parts)))))

    return each


def shared_shingles(mails: DataFrame) -> DataFrame:
    """(msg_id, h, owner, place): shingles of a message that an earlier one of its thread has; arrays as long as the message at most.

    The owner is the nearest earlier message, most likely the one replied to; messages of one instant aren't earlier than each
    other. A shingle of a hot thread may be in very many messages, so it is looked up within its day first and then in a summary of days.
    """
    dated = mails.where("thread <> '' AND at IS NOT NULL")
    sizes = dated.groupBy("thread").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = {r.thread for r in sizes.where(F.col("n") > max(HOT_LEAST, total / HOT_SHARE)).limit(HOT_SHARE).collect()}
    grams = dated.mapInPandas(_shingles(hot), "msg_id bigint, at bigint, h bigint, place int, cell bigint")
    grams = materialise(grams, "mail-shingles") if hot else grams
    origin = F.struct("at", F.col("msg_id").alias("id"), "place")
    earlier = Window.partitionBy("h", "cell").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = grams.withColumn("origin", F.max(origin).over(earlier))
    shared = near.where("origin IS NOT NULL").select("msg_id", "h", "origin")
    if hot:
        days = grams.where("cell > 0").groupBy("h", "cell").agg(F.max(origin).alias("latest"))
        before = days.select("h", "cell", F.lag("latest").over(Window.partitionBy("h").orderBy("cell")).alias("before")).where("before IS NOT NULL")
        first = near.where("origin IS NULL AND cell > 0").join(before, ["h", "cell"]).select("msg_id", "h", F.col("before").alias("origin"))
        shared = shared.unionByName(first)
    lists = shared.groupBy("msg_id").agg(F.collect_list(F.struct("h", F.col("origin.id").alias("owner"), "origin.place")).alias("s"))
    return lists.select("msg_id", "s.h", "s.owner", "s.place")


def _paragraph_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(msg_id, h, last, first): each plain paragraph of a message once, whether it is among the last of its stretch and the first of the message."""
    for b in batches:
        out = []
        for i, sender, body in zip(b["msg_id"], b["sender"], b["body"]):
            text = [t for _, t in logical_lines(body)]
            tokens = _name_words(sender)
            seen: dict[int, tuple[bool, bool]] = {}
            for no, stretch in enumerate(paragraphs_of(text, _quoted(text))):
                for at, (a, e) in enumerate(stretch):
                    h = standing_key(text[a:e], tokens)
                    last, first = seen.get(h, (False, False))
                    seen[h] = (last or at >= len(stretch) - TAIL, first or no == at == 0)
            out += [(i, h, *x) for h, x in seen.items() if h]
        yield pd.DataFrame(out, columns=["msg_id", "h", "last", "first"])


def standing_matter(mails: DataFrame) -> DataFrame:
    """(msg_id, standing): keys of the paragraphs of a message that are standing matter, learned over all messages."""
    keys = materialise(mails.mapInPandas(_paragraph_keys, "msg_id bigint, h bigint, last boolean, first boolean"), "mail-paragraphs")
    share = lambda c: F.sum(F.col(c).cast("int")) / F.count("*")
    learned = keys.groupBy("h").agg(F.count("*").alias("n"), share("last").alias("last"), share("first").alias("first")).where((F.col("n") >= SEEN) & (F.col("last") >= AT_END) & (F.col("first") <= AT_START))
    return keys.select("msg_id", "h").join(learned.select("h"), "h").groupBy("msg_id").agg(F.collect_list("h").alias("standing"))


def written_lines(df: DataFrame, lists: bool = True) -> DataFrame:
    """(msg_id, line_no) of every line newly written by its sender.

    Needs msg_id, subject, msg_date, sender and body. Null or empty bodies give no row; a message without a usable date or
    subject has no ancestors; repeated rows count once, and of rows with one id but other contents the greatest holds.
    """
    one = df.where("msg_id IS NOT NULL").groupBy("msg_id").agg(F.max(F.struct("body", "subject", "msg_date", "sender")).alias("r")).select("msg_id", "r.subject", "r.msg_date", "r.sender", "r.body").where("trim(body) <> ''")
    mails = materialise(one.mapInPandas(_describe, "msg_id bigint, thread string, at bigint, sender string, body string"), "mails")
    todo = mails.select("msg_id", "thread", "sender", "body").join(shared_shingles(mails), "msg_id", "left").join(standing_matter(mails), "msg_id", "left")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, no) for i, t, s, body, h, o, p, st in b.itertuples(index=False) for no in new_lines(body, s, t, None if h is None else (h, o, p), frozenset(st) if st is not None else frozenset(), lists)]
            yield pd.DataFrame(rows, columns=["msg_id", "line_no"])

    return todo.mapInPandas(each, "msg_id bigint, line_no int")
