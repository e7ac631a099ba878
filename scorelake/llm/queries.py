"""All registered queries of the subpackage, the pipeline's among them."""

from scorelake.llm import bitsliced, decontaminate, divergence, jaccard, mixing, nndescent, pii, secrets, substring, toxicity, urls, webtext, whitening  # noqa: F401
from scorelake.llm.registry import ORACLES, QUERIES  # noqa: F401
