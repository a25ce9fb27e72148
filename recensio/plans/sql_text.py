"""DuckDB SQL text of the same rules, for the oracle side of each query.

Only used to check results: every pattern is the one in
``recensio.functions.text``, written for RE2 (DuckDB's regex engine) with the
same explicit character classes.  RE2 has no Unicode ``\\b``; the words it
guards ("verificata", "verifica") never follow or precede a non-ASCII letter
in the test tables.
"""

from __future__ import annotations

from recensio.config import ITALIAN_MONTHS, ITALIAN_STOPWORDS, Config
from recensio.functions.text import DIGIT, SPACE, WORD
from recensio.sources.tables import COMPANIES, FIXED_THEMES, REVIEWS_PER_PAGE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def rr(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def clean_steps_sql(expr: str, months=ITALIAN_MONTHS) -> str:
    m = "|".join(months)
    t = f"lower({expr})"
    t = rr(t, rf"pubblicata il {DIGIT}{{1,2}} [{WORD}]+ {DIGIT}{{4}}")
    t = rr(t, r"data dell'esperienza:[^\n]*")
    t = rr(t, rf"{DIGIT}{{1,2}}[{SPACE}]+({m})[{SPACE}]+{DIGIT}{{4}}")
    t = rr(t, rf"({m})[{SPACE}]+{DIGIT}{{4}}")
    t = rr(t, r"\bverificat[aoe]\b")
    t = rr(t, r"\bverifica\b")
    t = rr(t, "stelle su 5")
    t = rr(t, rf"{DIGIT}+ stelle")
    t = rr(t, rf"valutato {DIGIT}")
    t = rr(t, rf"[^{WORD}{SPACE}]", " ")
    t = rr(t, rf"{DIGIT}+")
    return t


def clean_words_sql(expr: str, stopwords=ITALIAN_STOPWORDS, months=ITALIAN_MONTHS) -> str:
    stop = sql_list(dict.fromkeys(stopwords))
    split = f"regexp_split_to_array({clean_steps_sql(expr, months)}, {q('[' + SPACE + ']+')})"
    return f"list_filter({split}, lambda w: length(w) > 2 and not list_contains({stop}, w))"


def rating_from_text_sql(expr: str) -> str:
    low = f"lower({expr})"
    star = f"regexp_extract({low}, {q('(' + DIGIT + ')[' + SPACE + ']*stell[ae]')}, 1)"
    rated = f"regexp_extract({low}, {q('valutato[' + SPACE + ']*(' + DIGIT + ')')}, 1)"
    return f"coalesce(try_cast(nullif({star}, '') as integer), try_cast(nullif({rated}, '') as integer))"


def date_text_sql(expr: str, months=ITALIAN_MONTHS) -> str:
    pat = rf"({DIGIT}{{1,2}}[{SPACE}]+(?:{'|'.join(months)})[{SPACE}]+{DIGIT}{{4}})"
    return f"nullif(regexp_extract({expr}, {q(pat)}, 1), '')"


def theme_keywords_sql(expr: str) -> str:
    split = f"regexp_split_to_array(lower({expr}), {q('[' + SPACE + ']+')})"
    return f"list_slice(list_filter({split}, lambda w: length(w) > 3), 1, 3)"


RAW_REVIEWS = f"""
select 'c' || cast(d.doc_id % {COMPANIES} as varchar) as company,
       d.doc_id // {COMPANIES} as seq,
       cast(d.doc_id // {COMPANIES} // {REVIEWS_PER_PAGE} as integer) + 1 as pagina,
       cast(d.doc_id // {COMPANIES} % {REVIEWS_PER_PAGE} as integer) as pos,
       'https://reviews.example/review/c' || cast(d.doc_id % {COMPANIES} as varchar) || '?page=' ||
         cast(cast(d.doc_id // {COMPANIES} // {REVIEWS_PER_PAGE} as integer) + 1 as varchar) as page_url,
       case when d.doc_id % 97 = 0 then null else md5(d.text) end as review_id,
       case when l.quality = 1 and l.toxic = 0 then '5' when l.quality = 1 then '3'
            when l.toxic = 0 then '2' when l.toxic = 1 then '1' end as rating_attr,
       cast(null as varchar) as rating_div,
       concat(case when d.doc_id % 5 = 0 then 'Valutato 4 stelle su 5 Pubblicata il 12 marzo 2024 '
                   when d.doc_id % 5 = 1 then 'Recensione verificata del 3 maggio 2023: '
                   when d.doc_id % 5 = 2 then '2 stelle. '
                   when d.doc_id % 25 = 3 then '0 stelle. ' else '' end,
              d.text,
              case when d.doc_id % 7 = 0 then concat(chr(10), 'Data dell''esperienza: 1 aprile 2024') else '' end) as testo
from documents d left join labels l on d.doc_id = l.doc_id
"""

LINK_BASE = Config().link_base

REVIEWS = f"""
select company, seq, pagina, pos, review_id, testo, testo_pulito, parole, rating, data, link
from (
  select *, array_to_string(parole, ' ') as testo_pulito
  from (
    select company, seq, pagina, pos, review_id, testo,
           case when coalesce(rating_attr, '') <> '' then try_cast(rating_attr as integer)
                when rating_div is not null then try_cast(rating_div as integer)
                else {rating_from_text_sql('testo')} end as rating,
           {date_text_sql('testo')} as data,
           case when coalesce(review_id, '') <> '' then {q(LINK_BASE)} || review_id else page_url end as link,
           {clean_words_sql('testo')} as parole
    from raw_reviews
    where length(testo) >= 50
      and not (coalesce(rating_attr, '') <> '' and try_cast(rating_attr as integer) is null)
      and not (coalesce(rating_attr, '') = '' and rating_div is not null
               and try_cast(rating_div as integer) is null)
  )
)
"""

BAND = """
case when rating is not null and rating <> 0 and rating >= 4 then 'punti_forza'
     when rating is not null and rating <> 0 and rating <= 2 then 'punti_debolezza' end
"""

THEMES = "select 'c' || cast(c as varchar) as company, t.* from (values " + ", ".join(
    f"({q(t)}, {p}, {q(s)})" for t, p, s in FIXED_THEMES
) + f") t(tipo, theme_pos, punto), range({COMPANIES}) r(c)"


def with_ctes(body: str, raw: str | None = None, **extra: str) -> str:
    """Prefix a query with the review CTEs (and any extra named CTEs).
    ``raw`` replaces the raw records, reading the base ones as ``raw_docs``."""
    ctes = {"raw_docs": RAW_REVIEWS, "raw_reviews": raw or "select * from raw_docs", "reviews": REVIEWS}
    ctes.update(extra)
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in ctes.items()) + "\n" + body
