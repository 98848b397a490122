"""fathomry: a Spark-native engine for knowledge retrieval over source trees and corpora."""
