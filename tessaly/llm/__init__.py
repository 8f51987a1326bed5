"""Operations on corpora of documents and vectors. Nothing else in the package imports this."""
