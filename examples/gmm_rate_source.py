"""Online Gaussian mixtures per key over a rate source, to the console.

    spark-submit examples/gmm_rate_source.py
"""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftwell.estimators import MultivariateGaussianMixture
from driftwell.streaming import to_console

if __name__ == "__main__":
    spark = SparkSession.builder.appName("gmm").getOrCreate()
    rate = spark.readStream.format("rate").option("rowsPerSecond", 100).load()
    centre = F.when(F.rand() < 0.3, 10.0).otherwise(1.0)
    samples = rate.select((F.col("value") % 10).cast("string").alias("stateKey"), F.array(centre + F.randn(), centre / 2 + F.randn()).alias("sample"))
    mixture = MultivariateGaussianMixture(stateKeyCol="stateKey", initialMeans=[[8.0, 3.0], [0.0, 1.0]], minibatchSize=10, decayRate=0.8)
    to_console(mixture.transform(samples).select("stateKey", "stateIndex", "mixtureModel.weights", "loglikelihood")).awaitTermination()
