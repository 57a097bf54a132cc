"""Operations on tables of texts, predictions, vectors and features."""
