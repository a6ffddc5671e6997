"""Text cleaning, tickers, links, language check and topics."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .keywords import Automaton
from .once import once

# Characters and what the cleaner makes of them.
REMOVED = "\u200b\u200c\u200d\u2060\ufffc\u20e3"
BLANKS = "\u202f\u00a0\u2009\u2002"
PUNCTUATION = {"—": " - ", "–": "-", "…": "...", "•": " - ", "‣": " - ", "‑": "-", "∙": "-", "：": ":"}
QUOTES = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"'}
ARROWS = {"↑": "[up]", "↓": "[down]", "⬆": "[up]", "⬇": "[down]", "▲": "[up]", "▼": "[down]", "↗": "[up]", "→": "", "▶": "", "↔": "", "↳": "", "⬅": ""}
# Emoji and their tokens.
EMOJI = {
    "🟢": "green", "🔴": "red", "🟡": "yellow", "📈": "up", "📉": "down", "🔼": "up", "🔽": "down", "🔻": "down", "🟠": "orange", "🔵": "blue", "🚀": "rocket",
    "🔥": "fire", "💩": "bad", "😭": "crying", "😂": "laughing", "🤣": "laughing", "😐": "neutral", "🥶": "cold", "💀": "dead", "✅": "check", "❌": "x",
    "👀": "eyes", "🤔": "thinking", "🙌": "celebrate", "🙏": "hope", "👑": "king", "🏆": "trophy", "🎯": "target", "🤯": "shocked", "😳": "surprised",
    "😑": "flat", "😕": "confused", "😮": "wow", "😲": "shocked", "😅": "nervous", "😉": "wink", "😎": "cool", "🫡": "salute", "🤝": "handshake",
    "💪": "strong", "❤": "heart", "💚": "green_heart", "🥲": "bittersweet", "🥹": "emotional", "🫣": "peeking", "🤷": "shrug", "📊": "chart", "🏦": "bank",
    "💰": "money", "💸": "money_fly", "💳": "card", "💼": "business", "🪙": "coin", "💵": "dollar", "💹": "chart_yen", "💯": "hundred", "♾": "infinity",
    "💊": "pharma", "💉": "vaccine", "🦠": "virus", "🧫": "biotech", "🏥": "hospital", "⚕": "medical", "🤖": "ai", "📱": "mobile", "💻": "computer",
    "🖥": "desktop", "☁": "cloud", "⚡": "energy", "🛢": "oil", "🚗": "auto", "🚖": "taxi", "🚘": "car", "🛩": "airline", "✈": "plane", "🚢": "ship",
    "🛳": "cruise", "🚚": "truck", "🏈": "football", "🎮": "gaming", "🕹": "joystick", "🍏": "apple", "🍎": "apple_red", "🐶": "doge", "🦅": "eagle",
    "🌊": "wave", "🧠": "brain", "🦾": "robot_arm", "🦿": "robot_leg", "🏢": "office", "🏰": "castle", "🏭": "factory", "🏗": "construction", "👷": "worker",
    "🛒": "shopping", "🛍": "bags", "📦": "package", "📺": "tv", "🎬": "movie", "🎥": "camera", "🎧": "headphones", "🎤": "mic", "🎙": "podcast",
    "🌐": "globe", "🌍": "earth", "🌎": "americas", "🌏": "asia", "🍕": "pizza", "🍟": "fries", "🍔": "burger", "🌮": "taco", "🌯": "burrito", "🥤": "drink",
    "☕": "coffee", "🍺": "beer", "🍿": "popcorn", "🍪": "cookie", "🥕": "carrot", "🌿": "herb", "🍄": "mushroom", "🌱": "seedling", "🌟": "star",
    "⭐": "star", "🔬": "research", "🔐": "secure", "🔒": "lock", "🔑": "key", "📶": "signal", "📡": "antenna", "🛰": "satellite", "💡": "idea", "⚙": "gear",
    "🛠": "tools", "⚖": "scales", "🧴": "lotion", "👟": "shoe", "👔": "tie", "👜": "handbag", "👓": "glasses", "🎿": "ski", "⛷": "skier", "🧘": "yoga",
    "🛌": "sleep", "🔮": "crystal", "🐐": "goat", "🦈": "shark", "🐳": "whale", "🦚": "peacock", "🦎": "lizard", "🏝": "island", "⛰": "mountain",
    "🌪": "tornado", "🌀": "cyclone", "❄": "cold", "🧨": "explosive", "💥": "explosion", "💨": "dash", "🔊": "loud", "🔋": "battery", "🛞": "wheel",
    "🫒": "olive", "🥇": "first", "🥈": "second", "🥉": "third", "🚨": "alert", "🧵": "thread", "✔": "check", "💎": "diamond",
}
# Signs that go although the ranges below don't hold them.
DROPPED = "⬛▪▫◾●"
# Ranges whose other signs go.
REST = re.compile("[\U0001f300-\U0001f9ff\u2600-\u27bf\U0001fa00-\U0001faff\U0001f1e0-\U0001f1ff\U0001f000-\U0001f02f\ufe00-\ufe0f\U000e0000-\U000e007f]+")

# Topics in order of precedence, and the substrings that show them.
TOPICS: dict[str, list[str]] = {
    "Earnings": ["earnings", "quarter", "q1", "q2", "q3", "q4", "1q", "2q", "3q", "4q", "eps", "fiscal", "fy25", "fy26", "quarterly", "annual report", "beats estimate", "misses estimate", "earnings report", "earnings preview", "earnings call", "net income", "gross margin", "operating income", "ebitda", "beats expectations", "misses expectations"],
    "Mergers & Acquisitions": ["merger", "acquisition", "acquire", "buyout", "takeover", "bought", "purchase", "acquiring", "merge", "consolidation", "joint venture", "spinoff", "spin-off", "demerger", "divestiture", "sale of", "sells stake"],
    "Guidance & Forecasts": ["guidance", "forecast", "outlook", "projection", "expects", "anticipates", "target", "price target", "pt ", "pt:", "estimate", "analyst", "upgrade", "downgrade", "rating", "initiates coverage", "raises", "lowers", "reaffirms", "maintains", "sees", "guides", "2025e", "2026e", "2027e", "forward", "next quarter"],
    "Regulatory & Legal": ["lawsuit", "litigation", "legal", "court", "judge", "ruling", "regulation", "regulatory", "sec ", "ftc", "doj", "fda", "fcc", "antitrust", "investigation", "probe", "fine", "penalty", "settlement", "compliance", "violation", "sanction", "policy", "law", "ban", "approved by", "approval", "denied", "patent", "copyright"],
    "Product Launch": ["launches", "unveiled", "announces new", "new product", "new feature", "released", "rolls out", "introducing", "debut", "new service", "new model", "version", "update", "upgrade to", "expands distribution", "now available", "coming soon", "pre-order", "delayed", "postponed", "canceled", "cancelled", "scrapped", "shelved", "foldable", "launch plans"],
    "Partnerships & Deals": ["partnership", "partners with", "collaboration", "deal with", "agreement with", "contract", "signs", "expands at", "distribution", "teams up", "joins forces", "alliance", "works with", "in talks", "negotiating", "discussing", "considering", "exploring", "cloud deal", "strategic deal", "interest from", "interested parties"],
    "Market Data": ["market cap", "stock price", "share price", "trading at", "trillion", "valuation", "shares", "stock is moving", "from $", "to $", "historical", "all-time", "since", "million to", "billion to"],
    "Company Strategy": ["plans to", "strategy", "expansion", "expanding", "automation", "automate", "operations", "restructuring", "reorganization", "scaling", "growth plan", "investing in", "focuses on", "pivoting", "shift", "transformation", "initiative", "robots", "replace", "workforce", "ai-powered", "digital transformation", "up for sale", "received interest", "snag the", "potentially", "reinvent", "effort to", "development", "breakthrough"],
    "Company Metrics": ["million users", "billion users", "customers", "subscribers", "hosted on", "operates", "manages", "revenue of", "sales of", "grew by", "increased by", "decreased by", "user growth", "active users", "monthly active", "daily active"],
    "Personnel Changes": ["ceo", "chief executive", "chief financial", "cfo", "cto", "coo", "executive", "appoints", "hired", "hires", "joins as", "steps down", "resigns", "departing", "layoffs", "cuts", "fires", "replaces", "names", "promoted to"],
    "Breaking News": ["breaking", "alert", "just in", "developing", "urgent", "shutdown", "crisis", "crash", "surge", "plunge", "spike", "record high", "record low", "halt", "suspended", "emergency", "unprecedented"],
}
OTHER = "Other"
MIN_LENGTH = 60


_BLANKS, _LINK, _ESCAPE = re.compile(" {2,}"), re.compile(r"https?://[^\s]+"), re.compile(r"\\([()[\]{}.,!?\-'#+_])")


def _replacements(quotes: bool) -> dict[int, str]:
    table = {**dict.fromkeys(REMOVED, ""), **dict.fromkeys(BLANKS, " "), **PUNCTUATION, **(QUOTES if quotes else {}), **ARROWS, **dict.fromkeys(DROPPED, ""), **{e: f" [{t}] " for e, t in EMOJI.items()}}
    return str.maketrans(table)


def _cleaner(quotes: bool) -> Callable[[str], str]:
    """A text's compatibility forms folded, signs and emoji as tokens, single blanks.

    ASCII and Latin letters (U+00C0 to U+024F), none of which change, are passed over.
    """
    table = _replacements(quotes)
    signs = re.compile("[^\x00-\x7fÀ-ɏ]+")

    def run(found: re.Match) -> str:
        return REST.sub("", found[0].translate(table))

    def clean(text: str) -> str:
        if not text.isascii():
            text = signs.sub(run, unicodedata.normalize("NFKC", text))
        return (_BLANKS.sub(" ", text) if "  " in text else text).strip()

    return clean


def normalized(texts: pd.Series, quotes: bool = False) -> pd.Series:
    """Compatibility forms folded, signs and emoji as tokens, single blanks.

    Curly quotes stay as they are unless ``quotes``.  Null and empty texts are returned.
    """
    clean = _cleaner(quotes)
    return texts.map(lambda text: clean(text) if text else text, na_action="ignore")


#: Bytes of UTF-8 whose texts are Python strings at once: up to four bytes a character, twice.
PIECE = 1 << 20


def _mapped(one: Callable[[str], str], texts: pa.Array) -> pa.Array:
    """``one`` of each text; null and empty ones are kept.  A batch is taken in pieces."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(sizes) // PIECE
    cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(texts)]
    done = [pa.array([x and one(x) for x in texts.slice(lo, hi - lo).to_pylist()], pa.string()) for lo, hi in pairwise(cuts)]
    out = pa.concat_arrays(done)
    del done
    # Workers outlive their tasks, and what is freed here would stay with them.
    pa.default_memory_pool().release_unused()
    return out


@F.arrow_udf(StringType())
def clean_for_model(texts: pa.Array) -> pa.Array:
    return _mapped(_cleaner(False), texts)


@F.arrow_udf(StringType())
def clean_message(texts: pa.Array) -> pa.Array:
    """Links and blank lines go, escapes are undone, lines are joined, then as above."""
    clean = _cleaner(False)

    def one(text: str) -> str:
        if "://" in text:
            text = _LINK.sub("", text)
        if "\n" in text:
            text = "\n".join([x for x in map(str.strip, text.split("\n")) if x])
        else:
            text = text.strip()
        if "\\" in text:
            text = _ESCAPE.sub(r"\1", text)
        return clean(text.replace("\n", " "))

    return _mapped(one, texts)


def tickers(text: Column) -> Column:
    """Upper-case words behind a dollar sign, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(r"\$([A-Z][A-Z0-9]*)"), F.lit(1))


def tweet_url(text: Column) -> Column:
    return F.regexp_extract(text, r"(?U)(https?://(?:twitter\.com|x\.com)/[^\s)]+)", 1)


def is_english(text: Column) -> Column:
    """Fewer than a fifth of the letters are outside Latin; no letters: true; empty: false."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    latin = F.char_length(F.regexp_replace(text, "[^A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+", ""))
    share = F.when(letters == 0, F.lit(0.0)).otherwise((letters - latin) / letters)
    # The letters of ASCII are Latin.
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, F.lit(False)).when(ascii_only, F.lit(True)).otherwise(share < 0.2)


def is_valid(text: Column, least: int = MIN_LENGTH) -> Column:
    return F.coalesce((F.char_length(text) >= least) & is_english(text), F.lit(False))


def categorized(text: Column, topics: Mapping[str, Sequence[str]] = TOPICS) -> Column:
    """The first topic one of whose substrings the lower-cased text holds, else ``OTHER``."""
    automaton = Automaton(topics)

    @F.arrow_udf(StringType())
    def topic(low: pa.Array) -> pa.Array:
        return automaton.topics(low, OTHER)

    return topic(F.lower(text))


def tweet_hash(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 12)


def processed(tweets: DataFrame, least: int = 30) -> DataFrame:
    """One row per tweet and ticker of ``(id, ts, author, url, symbols, text)`` tweets.

    Tickers are those that came with the tweet and those in its text, upper-cased, each
    once; tweets without tickers or with an invalid text go.
    """
    return per_ticker(tweets, least).dropDuplicates(["id", "ticker"])


def per_ticker(tweets: DataFrame, least: int = 30) -> DataFrame:
    """The same for tweets whose ids differ, without a shuffle; a text is cleaned once."""
    found = F.array_distinct(F.concat(F.transform(F.coalesce("symbols", F.array().cast("array<string>")), lambda x: F.upper(x)), tickers(F.col("text"))))
    rows = tweets.withColumn("tickers", once(found)).where(F.size("tickers") > 0)
    rows = rows.withColumn("clean", once(clean_message(F.col("text")))).where(is_valid(F.col("clean"), least))
    rows = rows.withColumn("category", categorized(F.col("clean"))).withColumn("ticker", F.explode("tickers"))
    return rows.select("id", "ts", "author", "ticker", F.col("url").alias("tweet_url"), "category", F.col("clean").alias("text"))
