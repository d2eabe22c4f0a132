"""A PySpark-native engine for temporal graphs: profiles, vertex programs, partitioners."""
