"""Options of the operators, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SampleOptions:
    """Sizes of the stratified sample."""

    total: int = 100_000
    min_per_stratum: int = 300
    min_per_substratum: int = 5
    max_share: float = 0.35
    seed: int = 25


@dataclass(frozen=True)
class VocabularyOptions:
    """What counts as a term."""

    ngram_max: int = 2
    min_df: int = 4
    max_df: float = 0.85
    min_df_divisor: int | None = None  # if given, a term needs 1/min_df_divisor of the units too
    max_features: int | None = 40_000
    min_chars: int = 1
    lemmas: bool = False
    df_unit: str = "document"
    stop_words: tuple[str, ...] | None = None
    extra_stop_words: bool = True


@dataclass(frozen=True)
class ClusterOptions:
    """Neighbourhood and group sizes of the density model."""

    min_samples: int = 20
    min_cluster_size: int = 80
    epsilon: float = 0.2


@dataclass(frozen=True)
class TopicOptions:
    """The whole topic model."""

    dimensions: int = 64
    components: int = 12
    vocabulary: VocabularyOptions = VocabularyOptions()
    clusters: ClusterOptions = ClusterOptions()
    top_words: int = 10


# The two published settings: about 100,000 and about 5,000 documents.
LARGE_SAMPLE = TopicOptions()
SMALL_SAMPLE = TopicOptions(
    components=5,
    vocabulary=VocabularyOptions(
        ngram_max=1, min_chars=2, min_df=2, min_df_divisor=100, max_features=None, extra_stop_words=False
    ),
    clusters=ClusterOptions(min_samples=3, min_cluster_size=15, epsilon=0.05),
)
