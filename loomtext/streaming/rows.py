"""The row-local operators over streams: they have no state, so a stream takes the same columns as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.aspects import remote_policy, spoken_languages


def tagged(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with search tokens, token estimate, spoken languages and remote policy."""
    c = F.col(text)
    return messages.withColumns({
        "tokens": T.search_tokens(c), "n_estimated": T.token_estimate(c),
        "languages": F.transform(spoken_languages(c), lambda x: x["value"]), "remote": F.get(F.transform(remote_policy(c), lambda x: x["value"]), F.lit(0)),
    })
