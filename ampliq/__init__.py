"""ampliq: amplicon-sequencing analytics as Spark DataFrame operators."""
