"""Plain helpers of the brute-force versions."""

from causeway.llm import common


def lowered(text):
    return (text or "").translate(str.maketrans(common.UPPER, common.LOWER))
