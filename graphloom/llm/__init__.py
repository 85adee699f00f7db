"""Operations of a training-data pipeline. Nothing else in graphloom imports this subpackage."""
