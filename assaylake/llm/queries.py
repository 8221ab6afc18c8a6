"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from .bpe import op6_bpe
from .chat import OP7_SQL, op7_chat
from .lexical import OP11_SQL, op11_lexical_search
from .line_dedup import OP1_SQL, op1_line_dedup
from .media import op8_media
from .mixing import OP4_SQL, op4_mixing
from .quality import OP10_SQL, op10_quality
from .secrets import OP12_SQL, op12_secrets
from .sharding import op2_sharding
from .simhash import op9_simhash
from .spelling import op13_spelling
from .token_counts import op5_token_counts
from .warc import OP3_SQL, op3_warc

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_warc, op4_mixing, op5_token_counts, op6_bpe, op7_chat, op8_media, op9_simhash, op10_quality, op11_lexical_search, op12_secrets, op13_spelling)}
SQL = {"op1_line_dedup": OP1_SQL, "op3_warc": OP3_SQL, "op4_mixing": OP4_SQL, "op7_chat": OP7_SQL, "op10_quality": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_secrets": OP12_SQL}
