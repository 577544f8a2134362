"""The whole preparation: options, presets, the nine column steps, batch scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Sequence
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..plans.lookups import lookup_join
from ..session import cut
from . import category as CAT
from . import cleaning as C
from . import encode as E
from . import interactions as I
from . import target as G
from . import textstats as S
from . import topics as TOP
from . import vectorize as V
from .models import add_score, predict_with_threshold
from .scale import scale, scale_groups, scale_table


@dataclass(frozen=True)
class SubjectOptions:
    source_col: str = "subject"
    keep_original: bool = False
    clean_text: bool = True
    normalize_separators: bool = True
    split_topics: bool = True
    primary_strategy: str = "first"
    rare_threshold: int = 10
    rare_label: str = "other"
    group_rare: bool = False
    max_topics_for_primary: int | None = None
    multi_topic_label: str = "multi-topic"
    add_length_features: bool = False
    add_topic_list: bool = False
    add_topic_count: bool = False
    add_multiple_topics_flag: bool = False
    add_primary: bool = False
    add_grouped: bool = False
    add_frequency: bool = False
    add_is_rare: bool = False
    add_label_rate: bool = False
    label_col: str | None = None
    scale: str = "none"


@dataclass(frozen=True)
class StatementOptions:
    source_col: str = "statement"
    original_output_col: str = "statement_original"
    output_col: str = "statement_clean"
    keep_original: bool = False
    lower: bool = True
    remove_html: bool = True
    remove_urls: bool = True
    replace_numbers: bool = False
    number_token: str = "num"
    stopword_removal: bool = False
    stoplist: tuple[str, ...] = ()
    keep_negations: bool = True
    remove_punctuation: bool = False
    repair_polluted_statements: bool = True
    add_rare_token_features: bool = False
    rare_token_threshold: int = 1
    add_spelling_errors: bool = False
    add_lexical_features: bool = False
    add_pollution_features: bool = False
    use_dictionary: bool = False
    add_ner_features: bool = False
    vectorizer_type: str = "none"
    vectorizer_max_features: int | None = None
    vectorizer_min_df: int = 1
    vectorizer_max_df: float = 1.0
    scale: str = "none"


@dataclass(frozen=True)
class CategoryOptions:
    """One category column; ``kind`` picks the cleaner, flags that a kind lacks stay off."""

    kind: str = "speaker"
    source_col: str = "speaker"
    drop: bool = False
    keep_original: bool = False
    clean_text: bool = True
    normalize_separators: bool = True
    normalize_state: bool = True
    group_rare: bool = False
    rare_threshold: int = 5
    rare_label: str = "other"
    add_frequency: bool = False
    add_is_rare: bool = False
    add_grouped: bool = False
    add_length_features: bool = False
    add_token_count: bool = False
    add_title_flag: bool = False
    add_comma_flag: bool = False
    add_period_flag: bool = False
    add_slash_flag: bool = False
    add_ampersand_flag: bool = False
    add_parentheses_flag: bool = False
    add_is_major_party: bool = False
    add_is_institutional: bool = False
    add_is_us_state: bool = False
    add_has_us_words: bool = False
    add_us_region: bool = False
    add_label_rate: bool = False
    label_col: str | None = None
    scale: str = "none"


@dataclass(frozen=True)
class FeatureOptions:
    statement_col: str = "statement_clean"
    statement_original_col: str = "statement_original"
    speaker_col: str = "speaker_clean"
    subject_col: str = "subject_clean"
    party_col: str = "party_affiliation_clean"
    speaker_job_col: str = "speaker_job_clean"
    state_col: str = "state_info_clean"
    label_col: str | None = None
    add_speaker_subject: bool = False
    add_speaker_party: bool = False
    add_subject_party: bool = False
    add_speaker_job_subject: bool = False
    add_state_party: bool = False
    add_speaker_statement_len_bucket: bool = False
    statement_len_bins: tuple[int, int] = (50, 150)
    add_speaker_label_rate: bool = False
    add_subject_label_rate: bool = False
    add_party_label_rate: bool = False
    add_speaker_avg_statement_len: bool = False
    add_subject_avg_statement_len: bool = False
    add_speaker_avg_punctuation: bool = False
    add_speaker_avg_number_ratio: bool = False
    add_negation_count: bool = False
    add_hedge_count: bool = False
    add_absolutist_count: bool = False
    add_numeral_count: bool = False
    add_proper_noun_count: bool = False
    add_readability: bool = False
    add_sentiment: bool = False
    scale: str = "none"


def _category(kind: str, source: str, **on) -> CategoryOptions:
    return CategoryOptions(kind=kind, source_col=source, **on)


@dataclass(frozen=True)
class PrepareOptions:
    """Defaults give the cleaned columns only."""

    key_col: str = "id"
    label_option: str = "skip"
    label_source_col: str = "label"
    id_option: str = "drop"
    subject: SubjectOptions = field(default_factory=SubjectOptions)
    statement: StatementOptions = field(default_factory=StatementOptions)
    speaker: CategoryOptions = field(default_factory=lambda: _category("speaker", "speaker"))
    speaker_job: CategoryOptions = field(default_factory=lambda: _category("job", "speaker_job"))
    party_affiliation: CategoryOptions = field(default_factory=lambda: _category("party", "party_affiliation"))
    state: CategoryOptions = field(default_factory=lambda: _category("state", "state_info"))
    fe: FeatureOptions = field(default_factory=FeatureOptions)

    @classmethod
    def from_flat(cls, **flat) -> "PrepareOptions":
        """Build from flat names such as ``subject_add_primary`` or ``speaker_job_rare_threshold``."""
        base = cls()
        own = {f.name for f in fields(cls)}
        groups: dict[str, dict] = {}
        top = {}
        for name, value in flat.items():
            if name in own:
                top[name] = value
                continue
            group = next((g for g in ("speaker_job", "party_affiliation", "subject", "statement", "speaker", "state", "fe") if name.startswith(g + "_")), None)
            if group is None:
                raise ValueError(f"unknown option {name!r}")
            groups.setdefault(group, {})[_short_name(name[len(group) + 1 :])] = value
        for group, values in groups.items():
            known = {f.name for f in fields(getattr(base, group))}
            unknown = set(values) - known
            if unknown:
                raise ValueError(f"unknown {group} option(s) {sorted(unknown)}")
            top[group] = replace(getattr(base, group), **values)
        return replace(base, **top)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> "PrepareOptions":
        nested = {"subject": SubjectOptions, "statement": StatementOptions, "fe": FeatureOptions}
        built = {}
        for k, v in values.items():
            if isinstance(v, dict):
                v = {n: tuple(x) if isinstance(x, list) else x for n, x in v.items()}
                v = nested.get(k, CategoryOptions)(**v)
            built[k] = v
        return cls(**built)


def _short_name(name: str) -> str:
    """Column-specific option names to the shared ones."""
    for owner in ("speaker", "job", "party", "state", "primary"):
        if name == f"add_grouped_{owner}":
            return "add_grouped"
    if name.startswith("add_") and name.endswith("primary_true_rate"):
        return "add_label_rate"
    if name in ("add_speaker_true_rate", "add_subject_true_rate", "add_party_true_rate"):
        return name.replace("true_rate", "label_rate")
    if name in ("add_subject_frequency", "add_subject_is_rare"):
        return name.replace("add_subject_", "add_")
    if name in ("job_label_col", "party_label_col"):
        return "label_col"
    return name


# --- presets ----------------------------------------------------------------

_SUBJECT_ALL = SubjectOptions(
    keep_original=True, group_rare=True, add_length_features=True, add_topic_list=True, add_topic_count=True,
    add_multiple_topics_flag=True, add_primary=True, add_grouped=True, add_frequency=True, add_is_rare=True,
)
_COMMON = dict(keep_original=True, group_rare=True, add_frequency=True, add_is_rare=True, add_grouped=True, add_length_features=True, add_token_count=True)
_SPEAKER_ALL = _category("speaker", "speaker", **_COMMON, add_title_flag=True, add_comma_flag=True, add_period_flag=True)
_JOB_ALL = _category("job", "speaker_job", **_COMMON, add_title_flag=True, add_comma_flag=True, add_slash_flag=True, add_ampersand_flag=True)
_PARTY_ALL = _category(
    "party", "party_affiliation", **_COMMON, add_comma_flag=True, add_slash_flag=True, add_ampersand_flag=True,
    add_parentheses_flag=True, add_is_major_party=True, add_is_institutional=True,
)
_STATE_ALL = _category("state", "state_info", **_COMMON, add_is_us_state=True, add_has_us_words=True)
_PLAIN = dict(
    group_rare=False, add_grouped=False, add_title_flag=False, add_comma_flag=False, add_period_flag=False, add_slash_flag=False,
    add_ampersand_flag=False, add_parentheses_flag=False, add_is_major_party=False, add_is_institutional=False,
)
_INTERACTIONS = dict(
    add_speaker_subject=True, add_speaker_party=True, add_subject_party=True, add_speaker_job_subject=True, add_state_party=True,
    add_speaker_statement_len_bucket=True,
)
_STYLE = dict(
    add_negation_count=True, add_hedge_count=True, add_absolutist_count=True, add_numeral_count=True, add_proper_noun_count=True, add_readability=True,
)

PRESETS = {
    "subject": {
        "minimal": replace(_SUBJECT_ALL, add_length_features=False, add_topic_list=False, add_grouped=False, group_rare=False),
        "expanded": _SUBJECT_ALL,
        "multi_topic": replace(_SUBJECT_ALL, primary_strategy="multi", max_topics_for_primary=3),
        "rare_safe": replace(_SUBJECT_ALL, primary_strategy="most_frequent", max_topics_for_primary=3),
    },
    "speaker": {"minimal": replace(_SPEAKER_ALL, **_PLAIN), "expanded": _SPEAKER_ALL, "rare_safe": _SPEAKER_ALL},
    "speaker_job": {"minimal": replace(_JOB_ALL, **_PLAIN), "expanded": _JOB_ALL, "rare_safe": _JOB_ALL},
    "party_affiliation": {"minimal": replace(_PARTY_ALL, **_PLAIN), "expanded": _PARTY_ALL, "rare_safe": _PARTY_ALL},
    "state": {
        "drop": replace(_STATE_ALL, drop=True),
        "minimal": replace(_STATE_ALL, group_rare=False, add_grouped=False, add_length_features=False, add_token_count=False, add_has_us_words=False),
        "expanded": replace(_STATE_ALL, add_us_region=True),
        "rare_safe": _STATE_ALL,
    },
    "fe": {
        "none": FeatureOptions(),
        "interactions": FeatureOptions(**_INTERACTIONS),
        "text": FeatureOptions(**_STYLE),
        "expanded": FeatureOptions(
            **_INTERACTIONS, **_STYLE, add_speaker_avg_statement_len=True, add_subject_avg_statement_len=True,
            add_speaker_avg_punctuation=True, add_speaker_avg_number_ratio=True,
        ),
    },
}


def preset(group: str, name: str):
    try:
        return PRESETS[group][name]
    except KeyError:
        raise ValueError(f"no preset {name!r} for {group!r}") from None


# --- validation -------------------------------------------------------------


def validate(df: DataFrame, o: PrepareOptions, resources: Collection[str] | None = None, fitted: bool = False) -> None:
    """Raise before anything is planned: KeyError for columns, ValueError for option conflicts.

    ``resources`` names the tables at hand; a ``fitted`` preparation reads no labels.
    """
    if o.label_option.strip().lower() not in ("skip", "drop"):
        raise ValueError("label_option must be 'drop' or 'skip'")
    if o.id_option.strip().lower() not in ("drop", "hash_bucket"):
        raise ValueError("id_option must be 'drop' or 'hash_bucket'")
    columns = [o.key_col, o.subject.source_col, o.statement.source_col]
    cats = [o.speaker, o.speaker_job, o.party_affiliation, o.state]
    C.require(df, *columns, *[c.source_col for c in cats])
    if o.subject.group_rare and not o.subject.add_primary:
        raise ValueError("subject: group_rare needs add_primary")
    if o.subject.primary_strategy.strip().lower() not in TOP.STRATEGIES:
        raise ValueError(f"subject: primary_strategy must be one of {TOP.STRATEGIES}")
    for c in cats:
        if c.group_rare and not c.add_grouped and not c.drop:
            raise ValueError(f"{c.source_col}: group_rare needs add_grouped")
    for part in [o.subject, *cats]:
        if part.add_label_rate:
            if part.label_col is None:
                raise ValueError(f"{part.source_col}: a label rate needs label_col")
            C.require(df, *([] if fitted else [part.label_col]))
    if (o.fe.add_speaker_label_rate or o.fe.add_subject_label_rate or o.fe.add_party_label_rate) and o.fe.label_col is None:
        raise ValueError("fe: label rates need label_col")
    for part in [o.subject, o.statement, *cats, o.fe]:
        if part.scale not in ("none", "standardize", "normalize"):
            raise ValueError("scale must be 'none', 'standardize' or 'normalize'")
    if o.statement.vectorizer_type not in ("none", *VECTORIZERS):
        raise ValueError(f"vectorizer_type must be 'none' or one of {sorted(VECTORIZERS)}")
    wanted = {"dictionary": o.statement.use_dictionary, "entities": o.statement.add_ner_features, "sentiment": o.fe.add_sentiment}
    lacking = [name for name, on in wanted.items() if on and name not in (resources or ())]
    if lacking:
        raise ValueError(f"options ask for tables that were not given: {lacking}")


# --- steps ------------------------------------------------------------------


def _restore_source(df: DataFrame, source: str, keep: bool) -> DataFrame:
    return df.withColumn(source, X.text(source)) if keep else df.drop(source)


@dataclass
class Fitting:
    """What the steps of one preparation share: the frame to fit tables on, and scaling left to the end.

    ``tables`` holds what steps fitted, by name. Frozen, it was fitted on other rows: steps take their tables
    from it and count or average nothing themselves.
    """

    base: DataFrame
    scaled: list[tuple[list[str], str]] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    frozen: bool = False

    def has(self, *cols: str | None) -> DataFrame | None:
        """The base if it has all the columns."""
        return self.base if not self.frozen and all(c in self.base.columns for c in cols) else None

    def table(self, name: str, fit: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.tables:
            if self.frozen:
                raise KeyError(f"the fitted preparation has no table {name!r}")
            self.tables[name] = fit()
        return self.tables[name]


def _source(fitting: Fitting | None, *cols: str | None) -> DataFrame | None:
    return fitting.has(*cols) if fitting else None


def _table(fitting: Fitting | None, name: str, df: DataFrame, fit: Callable[[DataFrame], DataFrame], *cols: str | None) -> DataFrame | None:
    """The step's table, fitted on the base (or on ``df`` where that lacks a column); None outside a preparation."""
    if fitting is None:
        return None
    base = fitting.has(*cols)
    return fitting.table(name, lambda: fit(df if base is None else base))


def _rate(df: DataFrame, key: str, label: str | None, out: str, fitting: Fitting | None) -> DataFrame:
    return G.group_label_rate(df, key, label, out, fitted=_table(fitting, out, df, lambda d: G.rate_table(d, key, label), key, label))


def _scaled(df: DataFrame, cols: list[str], method: str, fitting: Fitting | None) -> DataFrame:
    if fitting is None:
        return scale(df, cols, method)
    fitting.scaled.append((cols, method))
    return df


def prepare_subject(df: DataFrame, o: SubjectOptions = SubjectOptions(), fitting: Fitting | None = None) -> DataFrame:
    C.require(df, o.source_col)
    s = o.source_col
    clean = X.clean_subject(s, o.normalize_separators) if o.clean_text else X.strip(X.text(s))
    topics = f"{s}_topics"
    df = df.withColumn(f"{s}_clean", clean)
    df = df.withColumn(topics, TOP.topic_array(f"{s}_clean", o.split_topics))
    shaped = TOP.topic_shape(df, topics, f"{s}_clean", s)
    unwanted = [] if o.add_topic_count else [f"{s}_topic_count"]
    unwanted += [] if o.add_multiple_topics_flag else [f"{s}_has_multiple_topics"]
    unwanted += [] if o.add_length_features else [f"{s}_length", f"{s}_token_count"]
    df = shaped.drop(*unwanted)
    scalable = [f"{s}_topic_count"] * o.add_topic_count + [f"{s}_length", f"{s}_token_count"] * o.add_length_features
    if o.add_primary:
        primary = f"{s}_primary"
        counts = None
        if o.primary_strategy.strip().lower() == "most_frequent":
            counts = _table(fitting, f"{s}_topic_counts", df, lambda d: TOP.topic_counts(d, topics), topics)
        df = TOP.primary_topic(df, topics, o.primary_strategy, o.max_topics_for_primary, o.multi_topic_label, primary, _source(fitting, topics), counts)
        if o.add_frequency or o.add_is_rare or (o.group_rare and o.add_grouped):
            seen = _table(fitting, f"{s}_frequency", df, lambda d: CAT.frequency_table(d, primary), primary)
            df = TOP.primary_features(df, primary, s, o.rare_threshold, o.rare_label, fitted=seen)
            df = df.drop(*([] if o.add_is_rare else [f"{s}_is_rare"]), *([] if o.group_rare and o.add_grouped else [f"{primary}_grouped"]))
            df = df if o.add_frequency else df.drop(f"{s}_frequency")
        scalable += [f"{s}_frequency"] * o.add_frequency
        if o.add_label_rate:
            df = _rate(df, primary, o.label_col, f"{s}_label_rate", fitting)
    elif o.group_rare:
        raise ValueError("group_rare needs add_primary")
    if not o.add_topic_list:
        df = df.drop(topics)
    return _restore_source(_scaled(df, scalable, o.scale, fitting), s, o.keep_original)


def prepare_statement(df: DataFrame, o: StatementOptions = StatementOptions(), key: str = "id", fitting: Fitting | None = None) -> DataFrame:
    """Original-cased and cleaned text plus the switched-on features."""
    C.require(df, o.source_col)
    src, orig, clean = o.source_col, o.original_output_col, o.output_col
    scalable: list[str] = []
    if o.add_pollution_features:
        x = X.text(src)
        tabs, lines = X.literal_count(x, "\t"), X.chars_in(x, "[\n\r]")
        df = df.withColumns(
            {"statement_tab_count": tabs, "statement_newline_count": lines, "statement_row_spillover_flag": (tabs > 0) | (lines > 0)}
        )
        scalable += ["statement_tab_count", "statement_newline_count"]
    df = df.withColumn(orig, X.repair_statement(src, False, o.repair_polluted_statements))
    # The repaired text feeds the cleaner: structure is repaired once per row.
    df = df.withColumn(
        clean, X.clean_statement(orig, o.lower, o.remove_html, o.remove_urls, o.replace_numbers, o.number_token)
    )
    if o.remove_punctuation or o.stopword_removal or o.use_dictionary:
        t = X.words(F.col(clean))
        t = X.strip_token_punct(t) if o.remove_punctuation else t
        t = X.drop_stopwords(t, o.stoplist, o.keep_negations) if o.stopword_removal else t
        if o.use_dictionary:
            df = C.normalize_tokens_by_dictionary(df.withColumn("_t", t), key, "_t", fitting.tables["dictionary"])
            df = df.withColumn(clean, F.array_join("_t", " ")).drop("_t")
        else:
            df = df.withColumn(clean, F.array_join(t, " "))
    if o.add_lexical_features:
        df = S.lexical_features(df, orig, clean, src)
        scalable += [f"{orig}_char_len", f"{orig}_word_count", f"{src}_upper_ratio", f"{src}_exclamation_count", f"{src}_question_count", f"{clean}_digit_ratio"]
    if o.add_rare_token_features or o.add_spelling_errors:
        df = df.withColumn("_tokens", X.words(F.col(clean)))
        if o.add_rare_token_features:
            base = _source(fitting, key, clean)
            tokens = None if base is None else base.select(key, X.words(F.col(clean)).alias("_tokens"))
            seen = fitting.table(f"{clean}_tokens", lambda: CAT.token_frequencies(df if tokens is None else tokens, "_tokens")) if fitting else None
            df = S.rare_token_features(df, key, "_tokens", seen, o.rare_token_threshold, tokens)
            renamed = {"rare_token_count": f"{clean}_rare_token_count", "avg_token_freq": f"{clean}_avg_token_freq"}
            df = df.withColumnsRenamed(renamed)
            scalable += list(renamed.values())
        if o.add_spelling_errors:
            df = S.oov_count(df, key, "_tokens", out=f"{clean}_spelling_err_count")
            scalable.append(f"{clean}_spelling_err_count")
        df = df.drop("_tokens")
    if o.add_ner_features:
        df = S.gazetteer_entity_counts(df, key, orig, fitting.tables["entities"], f"{orig}_")
        scalable += [f"{orig}_{t}" for t in ["total_entities", *S.ENTITY_TYPES]]
    df = _scaled(df, scalable, o.scale, fitting)
    return df if o.keep_original else df.drop(orig)


def prepare_category(df: DataFrame, o: CategoryOptions, fitting: Fitting | None = None) -> DataFrame:
    C.require(df, o.source_col)
    s = o.source_col
    if o.drop:
        return df.drop(s)
    if not o.clean_text:
        clean = X.plain_category(s)
    elif o.kind in ("speaker", "job"):
        clean = (X.clean_speaker if o.kind == "speaker" else X.clean_job)(s, o.normalize_separators)
    else:
        clean = (X.clean_party if o.kind == "party" else X.clean_state)(s)
    value = f"{s}_clean"
    df = df.withColumn(value, clean)
    if o.kind == "state" and o.normalize_state:
        df = C.normalize_by_lookup(df, value, C.state_table(df.sparkSession), "code", "name", fixed=True)
    scalable: list[str] = []
    if o.add_frequency or o.add_is_rare or o.add_grouped:
        df = CAT.frequency_encode(df, value, s, fitted=_table(fitting, f"{s}_frequency", df, lambda d: CAT.frequency_table(d, value), value))
        freq = f"{s}_frequency"
        if o.add_is_rare:
            df = CAT.is_rare(df, freq, o.rare_threshold, f"{s}_is_rare")
        if o.add_grouped:
            df = CAT.group_rare(df, value, o.rare_threshold, o.rare_label, f"{s}_grouped", freq)
        if o.add_frequency:
            scalable += [freq, f"{s}_frequency_pct"]
        else:
            df = df.drop(freq, f"{s}_frequency_pct")
    if o.add_length_features:
        df = df.withColumn(f"{s}_char_len", F.length(value))
        scalable.append(f"{s}_char_len")
    if o.add_token_count:
        df = df.withColumn(f"{s}_token_count", X.word_count(F.col(value)))
        scalable.append(f"{s}_token_count")
    if o.add_title_flag:
        df = S.title_flag(df, s, W.SPEAKER_TITLES if o.kind == "speaker" else W.JOB_TITLES)
    raw = X.text(s)
    for on, name, mark in (
        (o.add_comma_flag, "comma", ","), (o.add_period_flag, "period", "."), (o.add_slash_flag, "slash", "/"), (o.add_ampersand_flag, "ampersand", "&"),
    ):
        if on:
            df = df.withColumn(f"{s}_has_{name}", X.flag(raw.contains(mark)))
    if o.add_parentheses_flag:
        df = df.withColumn(f"{s}_has_parentheses", X.flag(raw.rlike("[()]")))
    if o.add_is_major_party:
        df = S.membership_flag(df, value, W.MAJOR_PARTIES, f"{s}_is_major_party")
    if o.add_is_institutional:
        df = S.membership_flag(df, value, W.INSTITUTIONAL_ROLES, f"{s}_is_institutional")
    if o.add_is_us_state:
        df = S.membership_flag(df, value, [r[0] for r in W.US_STATES], f"{s}_is_us_state")
    if o.add_has_us_words:
        df = S.us_words_flag(df, value, f"{s}_has_us_words")
    if o.add_us_region:
        df = C.map_region(df, value, C.state_table(df.sparkSession), "name", "region", f"{s}_us_region", fixed=True)
    if o.add_label_rate:
        df = _rate(df, value, o.label_col, f"{s}_label_rate", fitting)
    return _restore_source(_scaled(df, scalable, o.scale, fitting), s, o.keep_original)


def add_cross_features(df: DataFrame, o: FeatureOptions = FeatureOptions(), fitting: Fitting | None = None, key: str = "id") -> DataFrame:
    """Interaction keys, group means and text style; absent sources warn and are skipped."""
    pairs = [
        (o.add_speaker_subject, o.speaker_col, o.subject_col, "fe_speaker_subject"),
        (o.add_speaker_party, o.speaker_col, o.party_col, "fe_speaker_party"),
        (o.add_subject_party, o.subject_col, o.party_col, "fe_subject_party"),
        (o.add_speaker_job_subject, o.speaker_job_col, o.subject_col, "fe_speaker_job_subject"),
        (o.add_state_party, o.state_col, o.party_col, "fe_state_party"),
    ]
    for on, a, b, out in pairs:
        if on:
            df = I.interaction_key(df, a, b, out)
    if o.add_speaker_statement_len_bucket:
        df = I.speaker_length_key(df, o.speaker_col, o.statement_col, o.statement_len_bins)
    scalable: list[str] = []
    rates = [
        (o.add_speaker_label_rate, o.speaker_col, "fe_speaker_label_rate"),
        (o.add_subject_label_rate, o.subject_col, "fe_subject_label_rate"),
        (o.add_party_label_rate, o.party_col, "fe_party_label_rate"),
    ]
    for on, group, out in rates:
        if on:
            if o.label_col is None:
                raise ValueError("label rates need label_col")
            if I.have(df, out, group, *([] if fitting and fitting.frozen else [o.label_col])):
                df = _rate(df, group, o.label_col, out, fitting)
                scalable.append(out)
    means = [
        (o.add_speaker_avg_statement_len, o.speaker_col, lambda c: X.word_count(X.text(c)), "fe_speaker_avg_statement_len"),
        (o.add_speaker_avg_punctuation, o.speaker_col, S.punct_density, "fe_speaker_avg_punctuation"),
        (o.add_speaker_avg_number_ratio, o.speaker_col, S.digit_ratio, "fe_speaker_avg_number_ratio"),
        (o.add_subject_avg_statement_len, o.subject_col, lambda c: X.word_count(X.text(c)), "fe_subject_avg_statement_len"),
    ]
    for group in (o.speaker_col, o.subject_col):
        wanted = {out: value(o.statement_col) for on, k, value, out in means if on and k == group and I.have(df, out, k, o.statement_col)}
        if wanted:
            sums = _table(fitting, f"fe_{group}_sums", df, lambda d, g=group, w=wanted: G.group_sums(d, g, w), group, o.statement_col)
            df = G.group_mean_features(df, group, wanted, fitted=sums)
            scalable += list(wanted)
    lexicons = {n: lex for n, lex in S.LEXICONS.items() if getattr(o, f"add_{n}_count")}
    if (lexicons or o.add_numeral_count or o.add_readability) and I.have(df, "text style", o.statement_col):
        df = S.lexicon_counts(df, o.statement_col, lexicons) if lexicons else df
        scalable += [f"fe_{n}_count" for n in lexicons]
        if o.add_numeral_count:
            df = S.numeral_count(df, o.statement_col)
            scalable.append("fe_numeral_count")
        if o.add_readability:
            df = S.flesch_reading_ease(df, o.statement_col)
            scalable.append("fe_readability")
    if o.add_proper_noun_count and I.have(df, "fe_proper_noun_count", o.statement_original_col):
        df = S.proper_noun_count(df, o.statement_original_col)
        scalable.append("fe_proper_noun_count")
    if o.add_sentiment and I.have(df, "sentiment", o.statement_col):
        df = S.lexicon_sentiment(df, key, o.statement_col, fitting.tables["sentiment"])
        scalable += ["fe_sentiment_polarity", "fe_sentiment_subjectivity"]
    return _scaled(df, scalable, o.scale, fitting)


def _clean_only(o: PrepareOptions) -> PrepareOptions:
    """The same cleaning without any feature: every step is then local to its row."""
    off = {"keep_original": True, "scale": "none"}

    def category(c: CategoryOptions) -> CategoryOptions:
        return CategoryOptions(kind=c.kind, source_col=c.source_col, drop=c.drop, clean_text=c.clean_text, normalize_separators=c.normalize_separators, normalize_state=c.normalize_state, keep_original=True)

    s = o.subject
    return replace(
        o, fe=FeatureOptions(), speaker=category(o.speaker), speaker_job=category(o.speaker_job), party_affiliation=category(o.party_affiliation), state=category(o.state),
        subject=replace(
            s, **off, group_rare=False, add_length_features=False, add_topic_count=False, add_multiple_topics_flag=False, add_grouped=False,
            add_frequency=False, add_is_rare=False, add_label_rate=False, add_topic_list=s.add_primary and s.primary_strategy.strip().lower() == "most_frequent",
        ),
        statement=replace(
            o.statement, **off, add_rare_token_features=False, add_spelling_errors=False, add_lexical_features=False, add_pollution_features=False,
            add_ner_features=False, vectorizer_type="none",
        ),
    )


def _fitted_columns(o: PrepareOptions) -> set[str]:
    """Cleaned columns, key and labels that some step of ``o`` counts or averages."""
    cols: set[str | None] = set()
    s = o.subject
    if s.add_primary and (s.add_frequency or s.add_is_rare or s.add_grouped or s.add_label_rate or s.primary_strategy.strip().lower() == "most_frequent"):
        cols |= {f"{s.source_col}_primary", f"{s.source_col}_topics", s.label_col if s.add_label_rate else None}
    if o.statement.add_rare_token_features or o.statement.vectorizer_type != "none":
        cols |= {o.key_col, o.statement.output_col}
    for c in (o.speaker, o.speaker_job, o.party_affiliation, o.state):
        if not c.drop and (c.add_frequency or c.add_is_rare or c.add_grouped or c.add_label_rate):
            cols |= {f"{c.source_col}_clean", c.label_col if c.add_label_rate else None}
    f = o.fe
    speaker = f.add_speaker_avg_statement_len or f.add_speaker_avg_punctuation or f.add_speaker_avg_number_ratio
    for on, key in ((speaker, f.speaker_col), (f.add_subject_avg_statement_len, f.subject_col)):
        cols |= {key, f.statement_col} if on else set()
    for on, key in ((f.add_speaker_label_rate, f.speaker_col), (f.add_subject_label_rate, f.subject_col), (f.add_party_label_rate, f.party_col)):
        cols |= {key, f.label_col} if on else set()
    return cols - {None}


def _steps(df: DataFrame, o: PrepareOptions, fitting: Fitting | None) -> DataFrame:
    return (
        df.transform(prepare_subject, o.subject, fitting)
        .transform(prepare_statement, o.statement, o.key_col, fitting)
        .transform(prepare_category, o.speaker, fitting)
        .transform(prepare_category, o.speaker_job, fitting)
        .transform(prepare_category, o.party_affiliation, fitting)
        .transform(prepare_category, o.state, fitting)
        .transform(add_cross_features, o.fe, fitting, o.key_col)
    )


def _fitting(df: DataFrame, o: PrepareOptions, resources: dict[str, DataFrame] | None) -> Fitting:
    """Cleaned columns that some step counts or averages, in one narrow checkpointed table."""
    given = dict(resources or {})
    wanted = _fitted_columns(o)
    if not wanted:
        return Fitting(df.select(), tables=given)
    clean = _steps(df, _clean_only(o), Fitting(df.select(), tables=given))
    return Fitting(cut(clean.select(*sorted(wanted & set(clean.columns)))), tables=given)


def _finish(df: DataFrame, o: PrepareOptions) -> DataFrame:
    if o.label_option.strip().lower() == "drop" and o.label_source_col in df.columns:
        df = df.drop(o.label_source_col)
    return C.id_option(df, o.id_option, o.key_col)


#: Word runs that are terms, by kind of vectoriser.
VECTORIZERS = {"tfidf": (1, 1), "bigram": (1, 2), "binary": (1, 1)}


def prepare(df: DataFrame, options: PrepareOptions | None = None, resources: dict[str, DataFrame] | None = None) -> DataFrame:
    """All steps in order, fitted on the rows themselves. The key column lives until the last step.

    ``resources``: ``dictionary(form, base)``, ``entities(phrase, type)``, ``sentiment(word, polarity, subjectivity)``
    for the options that look words up.

    Whatever is counted or averaged is fitted on one narrow table of cleaned columns, which is checkpointed
    here (an eager job, only if some option needs it); the rows then meet one table a step, and all scaling
    comes last from one aggregate. So the plan grows with the number of steps, and the input is read three
    times at most.
    """
    o = options or PrepareOptions()
    validate(df, o, resources)
    fitting = _fitting(df, o, resources)
    return _finish(scale_groups(_steps(df, o, fitting), fitting.scaled), o)


def prepare_keyed(df: DataFrame, options: PrepareOptions | None = None, resources: dict[str, DataFrame] | None = None) -> DataFrame:
    """``prepare`` that also keeps the key, for scoring and joins."""
    o = options or PrepareOptions()
    copied = df.withColumn("_key", F.col(o.key_col))
    return prepare(copied, o, resources).withColumnRenamed("_key", o.key_col)


@dataclass
class FittedPreparation:
    """A preparation fitted once: options, and every table its steps fitted or look words up in.

    What it makes of a row depends on that row alone, whichever rows come with it: values the fit never saw
    count 0 and are rare, unknown groups take the overall mean, unknown terms drop out.
    """

    options: PrepareOptions
    tables: dict[str, DataFrame]

    def transform(self, df: DataFrame, keep_key: bool = False) -> DataFrame:
        o = self.options
        validate(df, o, self.tables, fitted=True)
        df = df.withColumn("_key", F.col(o.key_col)) if keep_key else df
        fitting = Fitting(df.select(), tables=self.tables, frozen=True)
        ready = _steps(df, o, fitting)
        done = _finish(scale_groups(ready, fitting.scaled, self.tables.get("scale")), o)
        return done.withColumnRenamed("_key", o.key_col) if keep_key else done

    def vectors(self, df: DataFrame) -> DataFrame:
        """The statement vectoriser's rows ``(key, term, value)`` over the fitted vocabulary; long, so of any width."""
        o = self.options
        kind = o.statement.vectorizer_type
        if kind == "none":
            raise ValueError("the preparation has no vectoriser")
        statement = _clean_only(o).statement
        clean = prepare_statement(df.select(o.key_col, statement.source_col), statement, o.key_col, Fitting(df.select(), tables=self.tables, frozen=True))
        return statement_vectors(clean, o.key_col, statement.output_col, kind, self.tables["vocabulary"])

    def save(self, path: str) -> None:
        """Every table as parquet under ``path``, options and names as one JSON line."""
        spark = next(iter(self.tables.values())).sparkSession if self.tables else SparkSession.active()
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        told = json.dumps({"options": self.options.to_dict(), "tables": sorted(self.tables)})
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedPreparation":
        told = json.loads(spark.read.text(f"{path}/options").first()[0])
        return cls(PrepareOptions.from_dict(told["options"]), {name: spark.read.parquet(f"{path}/tables/{name}") for name in told["tables"]})


def fit_prepare(df: DataFrame, options: PrepareOptions | None = None, resources: dict[str, DataFrame] | None = None) -> FittedPreparation:
    """Fit every table of the preparation on ``df`` once, checkpointed; ``transform`` and ``vectors`` apply them."""
    o = options or PrepareOptions()
    validate(df, o, resources)
    fitting = _fitting(df, o, resources)
    _steps(df, o, fitting)
    s = o.statement
    if s.vectorizer_type != "none":
        terms = V.word_terms(s.output_col, VECTORIZERS[s.vectorizer_type])
        once = F.array_distinct(terms) if s.vectorizer_type == "binary" else terms
        fitting.tables["vocabulary"] = V.vocabulary(fitting.base, o.key_col, once, s.vectorizer_min_df, s.vectorizer_max_df, s.vectorizer_max_features)
    fitted = FittedPreparation(o, {name: cut(table) for name, table in fitting.tables.items()})
    if any(method != "none" and cols for cols, method in fitting.scaled):
        frozen = Fitting(df.select(), tables=fitted.tables, frozen=True)
        fitted.tables["scale"] = cut(scale_table(_steps(df, o, frozen), frozen.scaled))
    return fitted


def statement_vectors(df: DataFrame, key: str, clean: str, kind: str, vocabulary: DataFrame) -> DataFrame:
    """``(key, term, value)``: TF-IDF of unit length, counts of words and pairs, or 1 for words that occur."""
    terms = V.word_terms(clean, VECTORIZERS[kind])
    if kind == "tfidf":
        return V.transform_with_vocabulary(df, key, terms, vocabulary)
    counts = V.term_counts(df, key, F.array_distinct(terms) if kind == "binary" else terms)
    known = lookup_join(counts, vocabulary.select("term", F.lit(True).alias("_known")), "term")
    return known.where("_known").select(key, "term", F.col("tf").cast("double").alias("value"))


def prepare_topn(
    df: DataFrame, speaker_n: int = 50, job_n: int = 50, state_n: int = 30, stoplist: Sequence[str] = (), vocabulary: list[str] | None = None
) -> DataFrame:
    """The alternative preparation: missing flags, typed number tokens, topic columns, top-n categories."""
    df = C.missing_flags(df, ["speaker_job", "state_info"])
    df = C.fill_category(df, ["speaker", "speaker_job", "state_info", "party_affiliation", "subject"])
    df = C.normalize_unicode_text(df, "statement", "statement_normalized")
    tokens = X.alphabetic_tokens(X.typed_numbers("statement_normalized"))
    tokens = X.drop_stopwords(tokens, stoplist) if stoplist else tokens
    df = df.withColumn("statement_clean", F.array_join(tokens, " "))
    df = df.withColumn("subject_list", F.transform(F.split("subject", ","), X.strip))
    df, _ = TOP.multi_label_binarize(df, df, "subject_list", vocabulary=vocabulary)
    for col, n in (("speaker", speaker_n), ("speaker_job", job_n), ("state_info", state_n)):
        df, _ = CAT.keep_top_n(df, df, col, n)
    return CAT.keep_allow_list(df, "party_affiliation", W.TOP_PARTIES, out="party_top").drop("id")


def score_batch(bundle, df: DataFrame, key: str = "id", key_out: str = "id") -> DataFrame:
    """Prepare, look rates up, encode, align, score and cut: one ``(id, score, label)`` row per input row.

    With a fitted preparation in the bundle, a row's score does not depend on the rows scored with it.
    """
    if bundle.preparation is not None:
        fitted = bundle.preparation
        ready = FittedPreparation(replace(fitted.options, key_col=key), fitted.tables).transform(df, keep_key=True)
    else:
        options = PrepareOptions.from_dict(bundle.options) if bundle.options else PrepareOptions()
        ready = prepare_keyed(df, replace(options, key_col=key))
    ready = G.apply_rate_maps(ready, bundle.rate_maps, bundle.rate_fallback)
    ready = E.ordinal_apply(ready, bundle.encoders)
    aligned = E.align_schema(ready, bundle.feature_names, keep=[key])
    scored = add_score(bundle.model, aligned, "score")
    cut = predict_with_threshold(scored.select(F.col(key).alias(key_out), "score"), "score", bundle.threshold)
    return cut.select(key_out, "score", "label")
