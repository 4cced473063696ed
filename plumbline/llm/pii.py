"""Personal data: fixed base patterns, and looser candidates that boosted trees accept or reject."""

from __future__ import annotations

import random
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import boosting
from plumbline.llm.shared import spare, table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
#: Labelled examples that the trees are fitted on, and as many that the thresholds are calibrated on: spans made by rule, set into
#: passages of the documents. Neither follows the size of the corpus.
EXAMPLES = 3000
#: Bounds on the passages: of one language, and of all. They are the first in the order of the texts' hashes.
PASSAGES_A_LANGUAGE, PASSAGES = 200, 2000
#: A threshold of a language of its own needs this many calibration examples of a kind.
LEAST_CALIBRATION = 100
#: The least share of accepted candidates that must be personal data among the calibration examples.
PRECISION = 0.995

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that cannot start an address at its first digit cannot start one later, so the scan skips to the next run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LOOSE = (
    ("email", re.compile(r"(?<![\w.])[\w.+-]{1,64}\s?(?:@|[\[(]\s?at\s?[\])])\s?[\w-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[\w-]{2,63}){1,4}", re.I)),
    ("phone", re.compile(r"(?<![\w.+-])(?:\(?[0-9]{2,4}\)?[\x20./-]{1,2}){1,4}[0-9]{3,4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])00[1-9][0-9][\x20().0-9-]{7,18}[0-9]")),
    ("ip", re.compile(r"(?<![\w:])(?:(?:H:){3,7}H|(?:H:){1,6}(?::H){1,6}|::H(?::H){0,6}|(?:H:){1,7}:)(?![\w:])".replace("H", "[0-9A-Fa-f]{1,4}"))),
    ("card", re.compile(r"(?<![\w.])[0-9]{4}(?:[\x20./-]{1,3}[0-9]{4}){2,3}(?:[\x20./-]{1,3}[0-9]{1,4})?(?![\w.])")),
)
#: Every match of LOOSE holds a match of this.
GATE = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]|[0-9a-f]:[0-9a-f]|::", re.I)
CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|courriel|correo|kontakt|schreiben|contacter|écrire|escribir)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|sms|whatsapp|telefon|anruf|handy|rufnummer|téléphone|appeler|portable|teléfono|llamar|móvil)\b", re.I),
    "ip": re.compile(r"\b(?:ip|ipv6|address|host|server|client|from|adresse|rechner|von|serveur|depuis|dirección|servidor|desde)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|pan|karte|kreditkarte|zahlung|carte|crédit|paiement|tarjeta|crédito|pago)\b", re.I),
}
NOT_CUE = re.compile(r"\b(?:version|isbn|issn|doi|order|invoice|serial|part|page|pages|vol|date|year|fig|section|chapter|sku|no|ratio|score)\b\.?:?\s*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) by start, then kind: each kind's leftmost matches that do not overlap, without those that fail its check."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        if at >= done and (found := DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, found.end()))
                done = found.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        out += (("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += (("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m.group())) <= 15)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Looser proposals, which may overlap each other."""
    return [(kind, m.start(), m.end()) for kind, pattern in LOOSE for m in pattern.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - 30) : start], text[end : end + 12]
    digits = [c for c in span if "0" <= c <= "9"]
    groups = re.findall(r"[0-9]+", span)
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len({c for c in span if not c.isalnum()}),
        float(luhn("".join(digits))) if digits else 0.0,
        float("(" in span and ")" in span),
        float("@" in span),
        float(bool(re.search(r"\bat\b|\bdot\b", span, re.I))),
        len(re.split(r"[.\])]", span)[-1].strip()),
        len(set(digits)),
        float(bool(CUES[kind].search(before))),
        float(bool(NOT_CUE.search(before))),
        float(before[-1:].isalnum() or after[:1].isalnum()),
        float(bool(re.search(r"[$€£#=%/]\s*$", before) or re.match(r"\s*[%€$°]", after))),
        float(groups[0].startswith(("19", "20")) and len(groups[0]) == 4) if groups else 0.0,
        float("/" in span),
        float(len(re.findall(r"[A-Fa-f]", span)) > 0 and ":" in span),
        float("::" in span),
    ]


def examples(n: int, seed: int, passages: Sequence[tuple[str | None, str]] = ()) -> tuple[list[str], list[tuple[str, int, int]], list[int], list[str | None]]:
    """Labelled candidates made by rule, set into passages(lang, text) at a space, or into made-up words without them: texts, one
    candidate of each, 1 where it is personal data, and the language."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(3, 8)))

    def card() -> str:
        body = "4" + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def email():
        a, b = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (AT) ", " (DOT) "), ("(At)", "(Dot)"), (" [ at ] ", " [ dot ] "), ("@", " . "), (" @ ", ".")])
        return "email", f"{rng.choice([w() + '.', ''])}{w()}{a}{w()}{b}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}", rng.choice(["write to ", "mail: ", "contact ", "Kontakt: ", "courriel ", "correo ", ""])

    def phone():
        s = rng.choice(" -.")
        return "phone", rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0049 {d(3)} {d(4)} {d(3)}", f"0{d(3)} {d(3)} {d(4)}"]), rng.choice(["call ", "tel: ", "phone ", "mobile ", "fax: ", "Telefon ", "téléphone ", "teléfono "])

    def ip():
        group = lambda: f"{rng.randrange(1, rng.choice([256, 65536])):x}"
        span = ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8))
        if rng.random() < 0.5:  # compressed
            head = rng.choice(["2001:db8", "fe80", "", ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(rng.randint(1, 4)))])
            span = f"{head}::{':'.join(group() for _ in range(rng.randint(0 if ':' in head else 1, 3)))}"
        return "ip", span, rng.choice(["from ", "host ", "ip ", "server ", ""])

    def plastic():
        c = card()
        sep = rng.choice([" - ", "/", ".", "  "])
        return "card", sep.join(c[i : i + 4] for i in range(0, 16, 4)), rng.choice(["card ", "visa: ", "payment by ", "debit ", "Karte ", "carte ", "tarjeta "])

    def not_phone():
        return "phone", rng.choice([f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", f"{d(2)}.{d(2)}.{rng.randint(1900, 2030)}", f"{d(3)} {d(3)}", f"{d(4)}/{d(4)}", f"{d(2)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(2)} {d(4)}", f"00{rng.randint(10, 99)}{d(rng.randint(8, 14))}", f"{d(2)}.{d(3)}.{d(3)}"]), rng.choice(["order ", "isbn ", "page ", "version ", "", "year ", "$", "serial "])

    def not_email():
        return "email", f"{w()} @ {w()} . {w()}", rng.choice(["x ", "price ", ""])

    def not_ip():
        names = ["add", "bad", "cafe", "dead", "face", "ace", "bed", "fade"]
        return "ip", rng.choice([":".join(d(2) for _ in range(rng.randint(4, 5))), f"{rng.choice(names)}::{rng.choice(names)}"]), rng.choice(["ratio ", "score ", "time ", ""])

    def not_card():
        return "card", rng.choice(" -/.").join(d(4) for _ in range(rng.choice([3, 4]))), rng.choice(["order ", "serial ", "isbn ", ""])

    texts, spans, labels, langs = [], [], [], []
    makers = [(email, 1), (phone, 1), (ip, 1), (plastic, 1), (not_phone, 0), (not_email, 0), (not_ip, 0), (not_card, 0)]
    for k in range(n):
        make, label = makers[k % len(makers)]
        kind, span, cue = make()
        lang, passage = rng.choice(passages) if passages else (None, f"{w()} {w()} {w()}")
        places = [0, *(m.end() for m in re.finditer(r"\s", passage))]
        cut = rng.choice(places)
        lead = passage[:cut] + cue
        texts.append(lead + span + rng.choice([" ", ". ", ", "]) + passage[cut:])
        spans.append((kind, len(lead), len(lead) + len(span)))
        labels.append(label)
        langs.append(lang)
    return texts, spans, labels, langs


Limits = dict[tuple[str, str | None], float]


def _least(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which at least the share precision is true; above one where there is none."""
    order = np.argsort(-p, kind="stable")
    last = np.append(p[order][1:] != p[order][:-1], True)  # of equal probabilities all or none are taken
    good = np.flatnonzero(last & (np.cumsum(y[order]) / np.arange(1, len(order) + 1) >= precision)) if len(order) else []
    return float(p[order][good[-1]]) if len(good) else 2.0


@lru_cache(4)
def trained(passages: tuple[tuple[str | None, str], ...] = (), n: int = EXAMPLES, precision: float = PRECISION) -> tuple[tuple, Limits]:
    """The trees, and for each kind, and kind and language, the least probability at which the share of true ones among held-out
    examples is precision. Every other passage is held out, and so are the spans in them."""
    def matrix(seed, own):
        texts, spans, labels, langs = examples(n, seed, own)
        return np.array([features(t, *s) for t, s in zip(texts, spans, strict=True)], float), np.array(labels, float), np.array([lang or "" for lang in langs])

    x, y, _ = matrix(11, passages[::2])
    model = boosting.fit(x, y)
    x, y, langs = matrix(12, passages[1::2])
    p = boosting.predict(model, x)
    limits: Limits = {}
    for k, kind in enumerate(KINDS):
        own = x[:, 0] == k
        limits[kind, None] = _least(p[own], y[own], precision)
        for lang in sorted(set(langs) - {""}):
            here = own & (langs == lang)
            if here.sum() >= LEAST_CALIBRATION:
                limits[kind, lang] = _least(p[here], y[here], precision)
    return model, limits


def sampled_passages(docs: DataFrame) -> tuple[tuple[str | None, str], ...]:
    """(lang, passage) of a bounded sample of docs(text): 100 characters from a place in the text that its hash gives, in the order of the hashes."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    h = F.xxhash64("text")
    at = F.pmod(h, F.greatest(F.length("text") - 100, F.lit(1))).cast("int") + 1
    rows = docs.where("length(text) > 0").select(lang.alias("lang"), h.alias("h"), F.substring("text", at, F.lit(100)).alias("passage"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "passage"))).where(F.col("k") <= PASSAGES_A_LANGUAGE)
    found = rows.orderBy("k", "lang", "h").limit(PASSAGES).collect()  # a bounded sample
    return tuple((r["lang"], p) for r in found for p in [r["passage"]] if not GATE.search(p))


def spans_of(text: str, model: tuple, limits: Limits, lang: str | None = None) -> list[dict]:
    base = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "score": 1.0, "base": True} for k, s, e in base]
    if GATE.search(text):
        loose = [c for c in candidates(text) if not any(c[1] < e and s < c[2] for _, s, e in base)]
        if loose:
            scores = boosting.predict(model, np.array([features(text, *c) for c in loose], float))
            taken: list[tuple[int, int]] = []
            for score, (kind, s, e) in sorted(zip(scores.tolist(), loose, strict=True), key=lambda x: (-x[0], x[1][1], x[1][2], x[1][0])):
                if score >= limits.get((kind, lang), limits[kind, None]) and not any(s < y and x < e for x, y in taken):
                    taken.append((s, e))
                    out.append({"kind": kind, "start": s, "end": e, "score": round(score, 6), "base": False})
    return sorted(out, key=lambda r: (r["start"], KINDS.index(r["kind"]), r["end"]))


def find_pii(docs: DataFrame, *keep: str, redact: bool = False, name: str = "spans") -> DataFrame:
    """The columns keep of docs(text) and, under a name that keep has not, spans: personal data in each whole text, by start, then kind; positions in code points.

    Base spans have base true and score 1. Candidates that overlap no base span are added where the boosted trees give at
    least their kind's calibrated probability; of overlapping ones the most probable stays. The trees and
    thresholds are fitted on examples in passages of docs itself, by language where docs has lang. Null and empty texts have no
    spans; repeated rows are treated one by one. With redact, text is added too, each span replaced by its kind in brackets.
    """
    trained_model = trained(sampled_passages(docs))
    schema = docs.select(*keep).schema.add(name, docs.sparkSession.range(0).select(F.lit(None).cast(SPANS)).schema[0].dataType)
    if redact:
        schema = schema.add("text", "string")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches):
        model, limits = trained_model
        for b in batches:
            texts, langs = b.columns[-2].to_pylist(), b.columns[-1].to_pylist()
            spans = [spans_of(t, model, limits, lang) if t else [] for t, lang in zip(texts, langs, strict=True)]
            more = [pa.array([redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())] if redact else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(spans, arrow), *more], names=[*keep, name, *["text"] * redact])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text, lang_ = spare("_text", keep), spare("_lang", keep)
    return docs.select(*keep, F.col("text").alias(text), lang.alias(lang_)).mapInArrow(run, schema)


def redacted(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span, or chain of overlapping spans, replaced by the first one's kind."""
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars, where there is one, counted again."""
    columns = docs.columns
    out = find_pii(docs, *(c for c in columns if c != "text"), redact=True, name=spare("_spans", columns))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out.select(*columns)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"), "doc_id")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = {f"n_{kind}": of(kind) for kind in KINDS}
    return found.withColumns(counts).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
