"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from cellarium.llm.chat import SQL as CHAT_SQL
from cellarium.llm.chat import op2_chat_parts
from cellarium.llm.decontaminate import op1_latent_retrieval
from cellarium.llm.fertility import op3_fertility
from cellarium.llm.langid import op4_cross_parsing
from cellarium.llm.licenses import op5_diagonal_voting
from cellarium.llm.mixing import op9_hierarchical
from cellarium.llm.secrets import op10_randomness
from cellarium.llm.simhash import op6_simhash
from cellarium.llm.urlrules import op7_association
from cellarium.llm.webtext import op8_suffix_array

QUERIES = {f.__name__: f for f in (op1_latent_retrieval, op2_chat_parts, op3_fertility, op4_cross_parsing, op5_diagonal_voting, op6_simhash, op7_association, op8_suffix_array, op9_hierarchical, op10_randomness)}
SQL = {"op2_chat_parts": CHAT_SQL}
