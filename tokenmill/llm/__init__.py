"""Training-data operators: language ID, exact top-k search, URL filters,
toxicity, n-gram scoring, near-duplicates, packing, SentencePiece coding, WARC
derivatives and benchmark decontamination.

One module per operator, ``queries`` registers the thin ``opN_`` queries.
Nothing outside this subpackage imports it.
"""
