"""siskin: a relational analytics engine expressed as Spark DataFrame programs."""
