"""Run parameters of one review analysis.

Everything an operator needs beyond its input DataFrames lives here, so the
same operators serve any site, language or band definition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: these must equal the behaviour being reproduced. ---------
# Italian stopwords dropped from cleaned review text (99 distinct words; the
# original list repeats "ho").
ITALIAN_STOPWORDS = (
    "il", "lo", "la", "i", "gli", "le", "di", "a", "da", "in", "con", "su", "per",
    "tra", "fra", "un", "una", "uno", "e", "ma", "anche", "come", "che", "non",
    "più", "meno", "molto", "poco", "tutto", "tutti", "tutte", "questo", "questa",
    "questi", "queste", "quello", "quella", "quelli", "quelle", "sono", "è", "ho",
    "hai", "ha", "hanno", "essere", "avere", "fare", "dire", "andare", "del", "della",
    "dei", "delle", "dal", "dalla", "dai", "dalle", "nel", "nella", "nei", "nelle",
    "sul", "sulla", "sui", "sulle", "al", "alla", "ai", "alle", "ottimo",
    "buono", "buona", "bene", "male", "servizio", "prodotto", "azienda", "sempre",
    "verificata", "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno",
    "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre",
    "lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato", "domenica",
)
# Italian month names, in calendar order (date patterns and keyword blacklist).
ITALIAN_MONTHS = (
    "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno",
    "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre",
)
# Terms whose presence (case-insensitive substring) removes a merged keyword.
KEYWORD_BLACKLIST = ("verificata",) + ITALIAN_MONTHS
# Fallback container selectors, tried only when no primary container exists:
# (tag, attribute, substring the attribute must contain).
FALLBACK_SELECTORS = (
    ("section", "class", "reviewContentwrapper"),
    ("div", "class", "review-content"),
    ("article", "class", "review"),
)
# The nine list categories of a merged model answer, in report order.
INSIGHT_CATEGORIES = (
    "punti_forza", "punti_debolezza", "leve_marketing", "parole_chiave",
    "suggerimenti_seo", "suggerimenti_adv", "suggerimenti_email",
    "suggerimenti_cro", "suggerimenti_sinergie",
)
SENTIMENT_CLASSES = ("positivo", "neutro", "negativo")
# Channel sheet rows: (label, category).
CHANNELS = (
    ("SEO", "suggerimenti_seo"),
    ("ADV", "suggerimenti_adv"),
    ("Email Marketing", "suggerimenti_email"),
    ("CRO", "suggerimenti_cro"),
    ("Sinergie", "suggerimenti_sinergie"),
)
# How many items each on-screen list shows.
TOP_N = {
    "topics": 5,
    "punti_forza": 10,
    "punti_debolezza": 10,
    "leve_marketing": 10,
    "suggerimenti_seo": 5,
    "suggerimenti_adv": 5,
    "suggerimenti_email": 5,
    "suggerimenti_cro": 5,
    "suggerimenti_sinergie": 5,
    "parole_chiave": 15,
}
# The review site's host and the prefix of a direct link to a review.
SITE_HOST = "trustpilot.com"
SITE_LINK_BASE = "https://it.trustpilot.com/reviews/"
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """Parameters of one analysis run."""

    host: str = SITE_HOST                        # URL predicate of the input check
    link_base: str = SITE_LINK_BASE
    stopwords: tuple[str, ...] = ITALIAN_STOPWORDS
    months: tuple[str, ...] = ITALIAN_MONTHS
    keyword_blacklist: tuple[str, ...] = KEYWORD_BLACKLIST
    primary_attr: str = "data-service-review-rating"
    fallback_selectors: tuple[tuple[str, str, str], ...] = FALLBACK_SELECTORS
    min_text_len: int = 50
    block_words: int = 8000
    max_features: int = 100
    min_df: int = 2
    max_df: float = 0.8
    n_init: int = 10
    kmeans_seed: int = 42
    kmeans_max_iter: int = 300
    positive_min: int = 4                        # strengths: rating >= 4
    negative_max: int = 2                        # weaknesses: rating <= 2
    identity: str = "strict"                     # or "text50"
    max_attempts: int = 3
    topic_examples: int = 3
    theme_examples: int = 2
    top_n: dict = field(default_factory=lambda: dict(TOP_N))
    # How themes meet reviews: "index" (word index, themes from data of any
    # number) or "broadcast" (a theme table that is a literal of the caller:
    # it scans every review text once per keyword).  Measured at sf0.1: 3,057
    # themes take 52 s broadcast and 9 s through the index.
    theme_plan: str = "index"
    # Companies of at most so many reviews are clustered whole in one task
    # (some 16 MB of vectors), larger ones in rounds over blocks.  The result
    # is the same.
    kmeans_rows: int = 20_000

    @staticmethod
    def italian() -> "Config":
        return Config()
