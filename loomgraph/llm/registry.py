"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from .audio import op6_audio
from .jaccard import op4_ngram_jaccard
from .katz import op9_katz
from .materialise import op8_materialise
from .mixing import op1_mixing
from .neighbours import op3_neighbours
from .pieces import op10_sentencepiece
from .periods import op12_periods
from .secrets import op5_secrets
from .sketches import op11_fingerprints
from .token_counts import op7_token_counts
from .toxicity import op2_toxicity
from .whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_neighbours, op4_ngram_jaccard, op5_secrets, op6_audio, op7_token_counts, op8_materialise, op9_katz, op10_sentencepiece, op11_fingerprints, op12_periods, op13_whitening)}
ORACLES: dict[str, str] = {}
