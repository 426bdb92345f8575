"""Taxonomies, weights and word lists of the domain. They have to be what they are for right results."""

from __future__ import annotations

# Section keys and labels, in display order.
SECTIONS = {
    "komparycja": "Komparycja / Skład",
    "tenor": "Tenor",
    "orzeka": "Orzeka",
    "postanawia": "Postanawia",
    "uzasadnienie_historyczne": "Uzasadnienie: część historyczna",
    "uzasadnienie_postepowanie": "Uzasadnienie: część postępowania",
    "uzasadnienie_prawne": "Uzasadnienie prawne",
    "uzasadnienie_ogolne": "Uzasadnienie (ogólne)",
    "zdanie_odrebne": "Zdanie odrębne",
    "sentencja_inna": "Sentencja (inne)",
    "inne": "Inne",
}
UNKNOWN = "inne"
SENTENCE_SECTIONS = ("tenor", "orzeka", "postanawia", "sentencja_inna")
REASONING_SECTIONS = ("uzasadnienie_historyczne", "uzasadnienie_postepowanie", "uzasadnienie_prawne", "uzasadnienie_ogolne")
# Names that queries may use for a section, besides keys and labels.
SECTION_ALIASES = {"holding": "tenor", "sentencja": "tenor", "dissent": "zdanie_odrebne", "uzasadnienie prawne": "uzasadnienie_prawne"}
SECTION_BUNDLES = {"holding only": ("tenor", "orzeka", "postanawia"), "reasoning only": ("uzasadnienie_prawne",), "dissent only": ("zdanie_odrebne",)}

DECISION_TYPES = {"postanowienie": "Postanowienie", "postanowienie_tymczasowe": "Postanowienie Tymczasowe", "rozstrzygniecie": "Rozstrzygnięcie", "wyrok": "Wyrok"}
BENCHES = {"pelny_sklad": "Pełny skład", "piecioosobowa": "Pięcioosobowa", "trojosobowa": "Trójosobowa"}
OUTSIDE_BENCH = "poza_klasyfikacja_ipo"

# What a hit in a section counts in search, and a token of it in similarity.
SEARCH_WEIGHTS = {
    "tenor": 1.45, "orzeka": 1.40, "postanawia": 1.35, "uzasadnienie_prawne": 1.22, "zdanie_odrebne": 1.15, "uzasadnienie_postepowanie": 1.08,
    "uzasadnienie_historyczne": 1.04, "uzasadnienie_ogolne": 1.02, "sentencja_inna": 1.02, "komparycja": 0.92, "inne": 1.0,
}
SIMILARITY_WEIGHTS = {
    "tenor": 1.35, "orzeka": 1.3, "postanawia": 1.3, "uzasadnienie_prawne": 1.25, "uzasadnienie_postepowanie": 0.95, "uzasadnienie_historyczne": 0.9,
    "uzasadnienie_ogolne": 0.85, "zdanie_odrebne": 0.8, "komparycja": 0.6, "sentencja_inna": 0.6, "inne": 0.6,
}
# Buckets of sections, and how many tokens of a paragraph count.
BUCKETS = {
    "tenor": "sentencja", "orzeka": "sentencja", "postanawia": "sentencja", "sentencja_inna": "sentencja", "uzasadnienie_prawne": "uzasadnienie_prawne",
    "uzasadnienie_historyczne": "uzasadnienie_pozostale", "uzasadnienie_postepowanie": "uzasadnienie_pozostale", "uzasadnienie_ogolne": "uzasadnienie_pozostale",
    "zdanie_odrebne": "zdanie_odrebne",
}
CAPS = {"sentencja": 1200, "uzasadnienie_prawne": 5000, "uzasadnienie_pozostale": 3000, "zdanie_odrebne": 1500, "inne": 1600}
FINAL_WEIGHTS = {"lexical": 0.52, "citations": 0.20, "metadata": 0.08, "dotyczy_bigrams": 0.20}
METADATA_WEIGHTS = {"repertory": 0.4, "bench": 0.2, "year": 0.2, "judges": 0.2}
TOP_K, THRESHOLD, YEAR_WINDOW, TOPIC_BIGRAMS, LEAST_TOKEN = 5, 0.12, 20, 160, 3
MIN_DF, MAX_DF_RATIO = 2, 0.12
PHRASE_BONUS, PAGE_SIZE, HITS_PER_CASE, SNIPPET, SNIPPET_LEAD, SIDEBAR_TERMS, BLOB_HITS, SHARD_TERMS = 1.4, 10, 3, 420, 120, 24, 32, 20_000
LEAST_RECLASSIFIED, REACH, FORCED_REACH, LEAST_PREDICTED = 0.72, 10, 30, 0.75

# What the forced pass gives: confidence and reason. A reason that another pass gave stands behind FORCED_PREFIX.
FORCED_PREFIX, FORCED_LEAST = "forced:", 0.72
FORCED = {
    "dissent": (0.78, "forced:dissent-lexical"),
    "nearest": (0.7, "forced:nearest-neighbor"),
    "previous": (0.68, "forced:prev-neighbor"),
    "next": (0.68, "forced:next-neighbor"),
    "early_order": (0.65, "forced:early-postanowienie"),
    "early": (0.65, "forced:early-default-tenor"),
    "legal": (0.64, "forced:legal-cues"),
    "procedure": (0.64, "forced:procedure-cues"),
    "history": (0.64, "forced:history-cues"),
    "late": (0.62, "forced:late-default-legal"),
    "other": (0.62, "forced:default-history"),
}
FORCED_MODEL = "forced-fallback"

# Sentences of similarity reasons, by component.
REASONS = {"citations": "Wspólne przepisy: ", "dotyczy_bigrams": "Wspólne frazy w tytule: ", "lexical": "Wspólne frazy w tekście: ", "metadata": "To samo repertorium: "}
NO_REASON = "Podobna struktura argumentacji i metadanych."

# The instruction that goes with paragraphs to a language model; {keys} are the section keys.
PROMPT = (
    "Jesteś asystentem prawnym klasyfikującym akapity orzeczeń polskiego Trybunału Konstytucyjnego.",
    "Dla każdego rekordu wybierz dokładnie jeden klucz sekcji.",
    "Dozwolone klucze: {keys}.",
    "Użyj treści akapitu, kontekstu (poprzedni i następny akapit), pozycji w dokumencie i języka prawniczego.",
    "Jeżeli nie masz pewności, wybierz 'inne'.",
    "Zwróć wyłącznie poprawny JSON bez markdown:",
    '{{"predictions":[{{"paragraph_id":"...","predicted_section_key":"...","confidence":0.0,"reason":"krótkie uzasadnienie"}}]}}',
    "confidence musi być w zakresie 0..1.",
)
MATRIX_ISSUES, MATRIX_WORDS, HISTORY_ENTRIES = 16, 12, 25

MONTHS = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "wrzesnia", "pazdziernika", "listopada", "grudnia")

# Stop words of corpus bigrams (folded).
BIGRAM_STOPWORDS = (
    "i", "oraz", "lub", "na", "w", "z", "do", "od", "o", "u", "a", "ze", "sie", "jest", "sa", "to", "ten", "ta", "te", "nie", "dla", "przez", "ktory", "ktora", "ktore", "jako", "po", "za",
    "co", "czy", "art", "ust", "pkt", "par", "sygn", "trybunal", "konstytucyjny", "ustawy", "ustawa", "konstytucji", "dnia", "roku", "orzeczenie", "postepowania", "otk", "zu", "poz", "nr",
    "dz", "lit", "dalej", "tk", "rp",
)
# Stop words of the sidebar; they hold diacritics although the tokens are folded.
SIDEBAR_STOPWORDS = (
    "i", "oraz", "lub", "na", "w", "z", "do", "od", "o", "u", "a", "ze", "się", "jest", "są", "to", "ten", "ta", "te", "nie", "dla", "przez", "który", "która", "które", "jako", "po", "za",
    "co", "czy", "art", "ust", "pkt", "par", "sygn", "trybunał", "konstytucyjny", "ustawy", "ustawa", "konstytucji", "dnia", "roku", "orzeczenie", "postępowania",
)
# Phrases that say nothing about a case.
NOISE_PHRASES = (
    "trybunału konstytucyjnego", "trybunale konstytucyjnym", "trybunałem konstytucyjnym", "rzeczypospolitej polskiej", "niniejszej sprawie", "tym samym", "tym zakresie",
    "punktu widzenia", "przede wszystkim", "przy tym", "pod uwagę", "tego rodzaju", "tego przepisu", "których mowa", "którym mowa", "w związku", "związku tym", "może być",
    "mogą być", "musi być", "zob wyrok", "por wyrok", "sierpnia trybunale", "sąd pytający", "pytający sąd", "zakresie jakim", "przed trybunałem",
)
# Inflected phrases and the one that they count as.
PHRASE_ALIASES = {
    "marszałek sejmu": "marszałek sejmu", "marszałka sejmu": "marszałek sejmu", "marszałkowi sejmu": "marszałek sejmu",
    "prokurator generalny": "prokurator generalny", "prokuratora generalnego": "prokurator generalny", "prokuratorem generalnym": "prokurator generalny",
    "rada ministrów": "rada ministrów", "rady ministrów": "rada ministrów", "radzie ministrów": "rada ministrów",
    "pytanie prawne": "pytanie prawne", "pytania prawnego": "pytanie prawne", "pytaniem prawnym": "pytanie prawne",
}

# Query fields, folded, and what they search.
FIELDS = {"sygn": "signature", "sedzia": "judge", "typ": "decision_type", "sekcja": "section", "rok": "year", "teza": "thesis"}
# Named facet bundles: sections, decision types.
PRESETS = {
    "holding": (("tenor", "orzeka", "postanawia"), ()),
    "dissent": (("zdanie_odrebne",), ()),
    "tenor": (("tenor",), ()),
    "uzasadnienie_prawne": (("uzasadnienie_prawne",), ()),
    "postanowienie": ((), ("postanowienie",)),
}
PORTAL_HOST = "ipo.trybunal.gov.pl"
