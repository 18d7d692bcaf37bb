"""The training-data operators as queries over whole tables, and SQL for those that SQL can express."""

from .decontaminate import op9_leaks
from .embeddings import op4_embeddings
from .language import op8_language
from .mixing import OP7_SQL, op7_poisson_mix
from .passages import OP2_SQL, op2_repeats
from .pii import op1_pii
from .quality import op5_quality
from .ranking import OP11_SQL, op11_ranking
from .simhash import op3_simhash
from .tokens import op10_token_ids
from .toxicity import op6_toxicity
from .trees import op13_neighbours
from .whitening import op12_whitening

QUERIES = {
    "op1_pii": op1_pii,
    "op2_repeats": op2_repeats,
    "op3_simhash": op3_simhash,
    "op4_embeddings": op4_embeddings,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_language": op8_language,
    "op9_leaks": op9_leaks,
    "op10_token_ids": op10_token_ids,
    "op11_ranking": op11_ranking,
    "op12_whitening": op12_whitening,
    "op13_neighbours": op13_neighbours,
}

ORACLE_SQL: dict[str, str] = {"op2_repeats": OP2_SQL, "op7_poisson_mix": OP7_SQL, "op11_ranking": OP11_SQL}
