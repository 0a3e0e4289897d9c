"""The score ladder (lower is better) and the constants of the inexact tiers."""

SCORES = {
    "EXACT": 0.0,
    "NORMALISED_EXACT": 0.1,
    "PREFIX": 0.5,
    "BOUNDARY_EXACT": 0.9,
    "BOUNDARY": 1.0,
    "MULTI_WORD": 1.5,
    "ACRONYM": 1.8,
    "CONTAINS": 2.0,
}
TYPO_PENALTY = 2.1
TIERS = ("exact", "normalised-exact", "prefix", "boundary-exact", "boundary", "multi-word", "acronym", "contains", "fuzzy", "corrected")
CHUNK_BASE, WHOLE_WORD, WORD_START, LONG_CHUNK, SCATTERED = 2.0, 0.2, 0.4, 0.8, 1.6
DENSITY_FLOOR, CHAIN_STARTS = 0.18, 4
MIN_RESCUE, MIN_TYPO, BUDGET, MIN_QUERY = 4, 5, 10, 2
