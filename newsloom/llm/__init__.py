"""Operations of a training-data pipeline; nothing else in newsloom imports this package."""
