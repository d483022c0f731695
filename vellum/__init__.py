"""vellum: document analytics as DataFrame plans on Apache Spark."""
