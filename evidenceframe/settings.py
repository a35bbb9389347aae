"""Default constants of the operators."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Defaults that results depend on.
    chunk_size: int = 900
    chunk_overlap: int = 120
    chunk_min: int = 80
    table_small_rows: int = 12
    table_group_rows: int = 8
    split_tokens: int = 7936
    hard_chars: int = 1800
    hard_part_min: int = 300
    hard_overlap: int = 80
    formula_min: int = 8
    formula_gap_lines: int = 2
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    top_k: int = 12
    page_top_k: int = 8
    table_top_k: int = 8
    hash_dim: int = 128
    min_vector_score: float = 0.15
    rrf_k: int = 60
    weights: dict[str, float] = field(
        default_factory=lambda: {"vector": 0.30, "bm25": 0.10, "rrf": 0.25, "rerank": 0.35, "relationship": 1.0, "agent": 0.20}
    )
    initial_threshold: float = 0.0
    rerank_threshold: float = 0.0
    final_threshold: float = 0.20
    guardrail_hits: int = 3
    guardrail_score: float = 0.30
    prior_min: float = 0.15
    prior_penalty: float = 0.70
    support_min: float = 0.45
    support_strong: float = 0.75
    support_weights: tuple[float, ...] = (0.30, 0.20, 0.15, 0.10, 0.10, 0.10, 0.05)
    variants_most: int = 4
    variant_min_letters: int = 3
    variant_boost: float = 0.03
    variant_boost_most: float = 0.12
    rerank_top: int = 8
    context_top: int = 6
    drop_labels: tuple[str, ...] = ("irrelevant",)
    drop_relevance: float = 0.25
    drop_needs_both: bool = True
    protect_prior: float = 0.55
    protect_rerank: float = 0.70
    protect_drop_labels: bool = False
    protect_anchors: bool = True
    route_confidence: float = 0.55
    carry_top: int = 4
    carry_score: float = 0.35
    max_retries: int = 2
    retry_factor: float = 1.5
    retry_top_most: int = 32
    retry_window_step: int = 1
    retry_window_most: int = 3
    expand_pages: int = 1
    context_seed_score: float = 0.55
    budget_ms: int = 30_000
    budget_tokens: int = 12_000
    min_gain: float = 0.05
    grade_head: int = 6
    grade_tail: int = 2
    grade_most: int = 8
    image_context_top: int = 3
    image_context_weight: float = 0.70
    prompt_chars: int = 12_000
    prompt_min_chars: int = 300
    slow_ms: int = 2000


DEFAULTS = Settings()
