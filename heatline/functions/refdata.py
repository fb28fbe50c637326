"""Reference tables of the calculation operators, as literal rows, DataFrames and SQL VALUES.

Every table is of fixed size, so operators may broadcast it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: standard atomic weights, g/mol ----
ATOMIC_WEIGHTS = [
    ("H", 1.008), ("He", 4.0026), ("Li", 6.94), ("Be", 9.0122), ("B", 10.81), ("C", 12.011), ("N", 14.007), ("O", 15.999), ("F", 18.998),
    ("Ne", 20.180), ("Na", 22.990), ("Mg", 24.305), ("Al", 26.982), ("Si", 28.085), ("P", 30.974), ("S", 32.06), ("Cl", 35.45), ("Ar", 39.948),
    ("K", 39.098), ("Ca", 40.078), ("Sc", 44.956), ("Ti", 47.867), ("V", 50.942), ("Cr", 51.996), ("Mn", 54.938), ("Fe", 55.845), ("Co", 58.933),
    ("Ni", 58.693), ("Cu", 63.546), ("Zn", 65.38), ("Ga", 69.723), ("Ge", 72.630), ("As", 74.922), ("Se", 78.971), ("Br", 79.904), ("Kr", 83.798),
    ("Rb", 85.468), ("Sr", 87.62), ("Y", 88.906), ("Zr", 91.224), ("Nb", 92.906), ("Mo", 95.95), ("Tc", 98), ("Ru", 101.07), ("Rh", 102.91),
    ("Pd", 106.42), ("Ag", 107.87), ("Cd", 112.41), ("In", 114.82), ("Sn", 118.71), ("Sb", 121.76), ("Te", 127.60), ("I", 126.90), ("Xe", 131.29),
    ("Cs", 132.91), ("Ba", 137.33), ("La", 138.91), ("Ce", 140.12), ("Pr", 140.91), ("Nd", 144.24), ("Sm", 150.36), ("Eu", 151.96), ("Gd", 157.25),
    ("Tb", 158.93), ("Dy", 162.50), ("Ho", 164.93), ("Er", 167.26), ("Tm", 168.93), ("Yb", 173.05), ("Lu", 174.97), ("Hf", 178.49), ("Ta", 180.95),
    ("W", 183.84), ("Re", 186.21), ("Os", 190.23), ("Ir", 192.22), ("Pt", 195.08), ("Au", 196.97), ("Hg", 200.59), ("Tl", 204.38), ("Pb", 207.2),
    ("Bi", 208.98), ("Po", 209), ("At", 210), ("Rn", 222), ("Fr", 223), ("Ra", 226), ("Ac", 227), ("Th", 232.04), ("Pa", 231.04), ("U", 238.03),
    ("Np", 237), ("Pu", 244), ("Am", 243), ("Cm", 247),
]

# ---- fixed values: common valences ----
VALENCES = [
    ("H", [1]), ("He", [0]), ("Li", [1]), ("Be", [2]), ("B", [3]), ("C", [-4, 2, 4]), ("N", [-3, 3, 5]), ("O", [-2]), ("F", [-1]), ("Ne", [0]),
    ("Na", [1]), ("Mg", [2]), ("Al", [3]), ("Si", [4]), ("P", [-3, 3, 5]), ("S", [-2, 4, 6]), ("Cl", [-1, 1, 3, 5, 7]), ("Ar", [0]), ("K", [1]),
    ("Ca", [2]), ("Sc", [3]), ("Ti", [2, 3, 4]), ("V", [2, 3, 4, 5]), ("Cr", [2, 3, 6]), ("Mn", [2, 3, 4, 6, 7]), ("Fe", [2, 3]), ("Co", [2, 3]),
    ("Ni", [2, 3]), ("Cu", [1, 2]), ("Zn", [2]), ("Ga", [3]), ("Ge", [4]), ("As", [3, 5]), ("Se", [-2, 4, 6]), ("Br", [-1, 1, 3, 5, 7]), ("Rb", [1]),
    ("Sr", [2]), ("Y", [3]), ("Zr", [4]), ("Nb", [3, 5]), ("Mo", [2, 3, 4, 5, 6]), ("Tc", [4, 7]), ("Ru", [2, 3, 4, 6, 8]), ("Rh", [2, 3, 4]),
    ("Pd", [2, 4]), ("Ag", [1]), ("Cd", [2]), ("In", [3]), ("Sn", [2, 4]), ("Sb", [3, 5]), ("Te", [-2, 4, 6]), ("I", [-1, 1, 3, 5, 7]), ("Cs", [1]),
    ("Ba", [2]), ("La", [3]), ("Ce", [3, 4]), ("Pr", [3, 4]), ("Nd", [3]), ("Sm", [2, 3]), ("Eu", [2, 3]), ("Gd", [3]), ("Tb", [3, 4]), ("Dy", [3]),
    ("Ho", [3]), ("Er", [3]), ("Tm", [3]), ("Yb", [2, 3]), ("Lu", [3]), ("Hf", [4]), ("Ta", [5]), ("W", [4, 6]), ("Re", [4, 6, 7]),
    ("Os", [3, 4, 8]), ("Ir", [3, 4]), ("Pt", [2, 4]), ("Au", [1, 3]), ("Hg", [1, 2]), ("Tl", [1, 3]), ("Pb", [2, 4]), ("Bi", [3, 5]), ("Th", [4]),
    ("U", [3, 4, 5, 6]),
]

# ---- fixed values: ten reactions: equation | standard enthalpy kJ/mol | standard entropy J/(mol K) | name ----
REACTIONS = [
    ("C + O₂ → CO₂", -393.5, 2.9, "碳完全燃烧"),
    ("2C + O₂ → 2CO", -221.0, 179.2, "碳不完全燃烧"),
    ("FeO + C → Fe + CO", 158.0, 150.0, "氧化亚铁碳还原（直接还原）"),
    ("Fe₂O₃ + 3CO → 2Fe + 3CO₂", -24.7, 15.6, "赤铁矿间接还原"),
    ("Fe₃O₄ + 4CO → 3Fe + 4CO₂", -14.5, 10.2, "磁铁矿间接还原"),
    ("CaCO₃ → CaO + CO₂", 178.3, 160.6, "碳酸钙分解（石灰石煅烧）"),
    ("SiO₂ + 2C → Si + 2CO", 689.6, 359.3, "二氧化硅碳还原（工业硅冶炼）"),
    ("2FeO + Si → 2Fe + SiO₂", -527.4, -52.8, "硅还原氧化亚铁（脱氧反应）"),
    ("MnO + C → Mn + CO", 276.1, 151.6, "氧化锰碳还原"),
    ("Fe₂O₃ + 2Al → 2Fe + Al₂O₃", -851.5, -38.0, "铝热反应"),
]

# ---- fixed values: Shomate coefficients: species, T_min, T_max (K), A to H ----
SHOMATE = [
    ("Fe(s)", 298, 1812, 17.49168, 24.76975, -6.94624, 0.13806, 0.01961, -4.95456, 41.31052, -4.74308),
    ("Fe(l)", 1812, 3500, 46.064, 0.0, 0.0, 0.0, 0.0, 42.05447, 53.2591, -4.74308),
    ("C(s,graphite)", 298, 1200, 0.10925, 38.87326, -36.30512, 11.48794, -0.0838, -4.32953, 24.0827, 0.0),
    ("O2(g)", 298, 6000, 30.03235, 8.772972, -3.988133, 0.788313, -0.741599, -11.32468, 236.1662, 0.0),
    ("CO2(g)", 298, 1200, 24.99735, 55.18696, -33.69137, 7.948387, -0.136638, -403.6075, 228.2431, -393.5224),
    ("CO(g)", 298, 1300, 25.56759, 6.09613, 4.054656, -2.671301, 0.131021, -118.0089, 227.3665, -110.5271),
    ("H2O(g)", 298, 2000, 30.09200, 6.832514, 6.793435, -2.534480, 0.082139, -250.8810, 223.3967, -241.8264),
    ("FeO(s)", 298, 1650, 47.24276, 10.02214, 0.80007, -1.55340, -0.85219, -276.6800, 266.8643, -272.0440),
    ("SiO2(s,alpha)", 298, 847, 75.93152, 7.80867, -1.66017, 0.13135, -1.18477, -920.8755, 263.8810, -910.7000),
    ("Al2O3(s,alpha)", 298, 2345, 102.4290, 38.7498, -15.9109, 2.628181, -3.007551, -1687.225, 357.532, -1675.700),
    ("Fe2O3(s)", 298, 1735, 119.1440, 18.17400, -2.07420, 0.08924, -5.17310, -846.6513, 327.7675, -824.2000),
    ("Fe3O4(s)", 298, 1800, 192.0030, 49.32200, -11.9244, 0.74424, -8.91540, -1137.946, 506.3882, -1118.400),
    ("CaO(s)", 298, 3200, 49.94690, 4.70788, -0.66722, 0.03850, -1.09855, -641.4345, 93.08890, -634.9000),
    ("CaCO3(s)", 298, 1200, 114.2770, 43.59130, -24.2467, 4.02190, -1.87760, -1235.455, 288.0198, -1207.600),
    ("MgO(s)", 298, 3100, 61.27750, -4.82340, 2.49861, -0.44295, -1.09283, -624.0971, 56.50680, -601.6000),
    ("MnO(s)", 298, 2000, 55.52150, 6.59680, 0.06625, -0.14407, -0.99690, -394.2485, 130.3913, -385.2000),
    ("H2(g)", 298, 2000, 33.06618, -11.36342, 11.43282, -2.77287, -0.15856, -9.98080, 172.7077, 0.0),
    ("N2(g)", 298, 6000, 26.09200, 8.21880, -1.97619, 0.15929, 0.04444, -7.17620, 216.3540, 0.0),
    ("Cu(s)", 298, 1358, 22.63710, 6.69520, 0.0, 0.0, -0.08979, -5.89196, 62.52760, 0.0),
    ("Ni(s)", 298, 1728, 17.35300, 25.82660, -8.24832, 0.79569, 0.28984, -7.16041, 64.38200, 0.0),
    ("Cr(s)", 298, 2180, 18.44300, 19.33380, -6.71010, 0.77285, -0.75546, -3.06130, 56.69440, 0.0),
    ("Si(s)", 298, 1687, 22.81720, 4.20720, -0.82349, 0.05735, -0.25670, -2.37548, 44.14520, 0.0),
    ("CH4(g)", 298, 1300, -0.703029, 108.4773, -42.52157, 5.862788, 0.678565, -76.84376, 158.7163, -74.87310),
    ("SO2(g)", 298, 1200, 21.43049, 74.35094, -57.75217, 16.35534, 0.086731, -305.7688, 254.8872, -296.8422),
    ("H2S(g)", 298, 1400, 26.88412, 18.67809, 3.434203, -3.378702, 0.135882, -28.91211, 233.3747, -20.50202),
    ("Cl2(g)", 298, 1000, 33.05060, 12.22940, -12.06510, 4.385330, -0.159494, -10.83480, 259.0290, 0.0),
    ("CuO(s)", 298, 1200, 35.36354, 5.412422, -4.335837, 1.355291, -0.083269, 295.2414, 275.5110, 306.2692),
    ("Cu2O(s)", 298, 1517, 95.39980, 4.892490, -1.982781, 0.284974, 1.522601, -155.9270, 213.9270, -111.9950),
    ("TiO2(s)", 298, 2000, 67.29830, 18.70940, -11.57900, 2.449561, -1.485471, -964.5140, 117.8630, -938.7220),
    ("Cr2O3(s)", 298, 2603, 156.9000, 0.000169, -0.000035, 0.000003, 0.000369, -1111.580, 252.7170, -1018.380),
    ("V2O5(s)", 943, 3000, 190.7904, 0.0, 0.0, 0.0, 0.0, -1559.055, 395.9378, -1491.211),
    ("AlN(s)", 298, 6000, 36.21495, 1.462133, -0.283742, 0.033794, -0.397324, 510.8078, 269.6701, 523.0),
    ("SiC(s)", 298, 1000, 60.32180, 4.423940, -61.79470, 39.06140, -1.675991, 696.3070, 277.6700, 719.6480),
    ("Si3N4(s)", 298, 3000, 55.63214, 157.7037, -63.61395, 8.610924, 0.213440, -767.0653, 137.2900, -744.7520),
    ("CaS(s)", 298, 1400, 33.08887, 15.89464, -21.61998, 10.84635, -0.123820, 112.7768, 268.0601, 123.5949),
    ("CaF2(s)", 298, 1690, 68.45240, 9.494700, -1.395660, -0.116730, -1.350913, -815.6713, 106.7184, -784.5000),
]

# ---- fixed values: units: name | symbol | dimension | factor to SI | offset to SI | least value | aliases ----
UNITS = [
    ("meter", "m", "length", 1.0, 0, None, ["米", "公尺"]),
    ("kilometer", "km", "length", 1000.0, 0, None, ["千米", "公里"]),
    ("decimeter", "dm", "length", 0.1, 0, None, []),
    ("centimeter", "cm", "length", 0.01, 0, None, ["公分"]),
    ("millimeter", "mm", "length", 0.001, 0, None, ["毫米"]),
    ("micrometer", "µm", "length", 1e-6, 0, None, ["um", "micron", "微米", "μm"]),
    ("nanometer", "nm", "length", 1e-9, 0, None, ["纳米"]),
    ("inch", "in", "length", 0.0254, 0, None, ["英寸", "\""]),
    ("foot", "ft", "length", 0.3048, 0, None, ["英尺", "'"]),
    ("yard", "yd", "length", 0.9144, 0, None, ["码"]),
    ("mile", "mi", "length", 1609.344, 0, None, ["英里"]),
    ("kilogram", "kg", "mass", 1.0, 0, None, ["千克"]),
    ("gram", "g", "mass", 0.001, 0, None, ["克"]),
    ("milligram", "mg", "mass", 1e-6, 0, None, ["毫克"]),
    ("metric_ton", "t", "mass", 1000.0, 0, None, ["tonne", "吨", "公吨"]),
    ("pound", "lb", "mass", 0.45359237, 0, None, ["磅"]),
    ("ounce", "oz", "mass", 0.028349523125, 0, None, ["盎司"]),
    ("us_ton", "us_ton", "mass", 907.18474, 0, None, ["short_ton", "美吨"]),
    ("second", "s", "time", 1.0, 0, None, []),
    ("millisecond", "ms", "time", 0.001, 0, None, []),
    ("microsecond", "µs", "time", 1e-6, 0, None, ["us", "μs"]),
    ("minute", "min", "time", 60.0, 0, None, ["分钟", "分"]),
    ("hour", "h", "time", 3600.0, 0, None, ["hr", "小时", "时"]),
    ("day", "d", "time", 86400.0, 0, None, ["天", "日"]),
    ("kelvin", "K", "temp", 1.0, 0, 0.0, ["开尔文"]),
    ("celsius", "°C", "temp", 1.0, 273.15, -273.15, ["C", "degC", "摄氏度", "℃"]),
    ("fahrenheit", "°F", "temp", 5.0 / 9.0, 459.67 * 5.0 / 9.0, -459.67, ["F", "degF", "华氏度"]),
    ("rankine", "°R", "temp", 5.0 / 9.0, 0.0, 0.0, ["R", "degR", "兰氏度"]),
    ("mole", "mol", "amount", 1.0, 0, None, ["摩尔"]),
    ("kilomole", "kmol", "amount", 1000.0, 0, None, ["千摩尔"]),
    ("square_meter", "m²", "area", 1.0, 0, None, ["m2", "sq_m", "平方米"]),
    ("square_centimeter", "cm²", "area", 1e-4, 0, None, ["cm2", "sq_cm", "平方厘米"]),
    ("square_millimeter", "mm²", "area", 1e-6, 0, None, ["mm2", "sq_mm", "平方毫米"]),
    ("square_inch", "in²", "area", 0.00064516, 0, None, ["in2", "sq_in", "平方英寸"]),
    ("square_foot", "ft²", "area", 0.09290304, 0, None, ["ft2", "sq_ft", "平方英尺"]),
    ("cubic_meter", "m³", "volume", 1.0, 0, None, ["m3", "立方米"]),
    ("liter", "L", "volume", 0.001, 0, None, ["l", "dm3", "升", "立方分米", "公升"]),
    ("milliliter", "mL", "volume", 1e-6, 0, None, ["ml", "cm3", "cc", "毫升"]),
    ("cubic_foot", "ft³", "volume", 0.028316846592, 0, None, ["ft3", "立方英尺"]),
    ("us_gallon", "gal", "volume", 0.003785411784, 0, None, ["gallon", "美加仑"]),
    ("barrel", "bbl", "volume", 0.158987294928, 0, None, ["桶"]),
    ("pascal", "Pa", "pressure", 1.0, 0, 0.0, []),
    ("kilopascal", "kPa", "pressure", 1000.0, 0, None, []),
    ("megapascal", "MPa", "pressure", 1e6, 0, None, []),
    ("gigapascal", "GPa", "pressure", 1e9, 0, None, []),
    ("bar", "bar", "pressure", 1e5, 0, None, ["巴"]),
    ("millibar", "mbar", "pressure", 100.0, 0, None, ["毫巴"]),
    ("atmosphere", "atm", "pressure", 101325.0, 0, None, ["标准大气压"]),
    ("torr", "Torr", "pressure", 133.322368421, 0, None, ["mmHg", "托"]),
    ("psi", "psi", "pressure", 6894.757293168, 0, None, ["lb_per_sq_in", "磅每平方英寸"]),
    ("mm_h2o", "mmH₂O", "pressure", 9.80665, 0, None, ["mmH2O", "毫米水柱"]),
    ("joule", "J", "energy", 1.0, 0, 0.0, []),
    ("kilojoule", "kJ", "energy", 1000.0, 0, None, []),
    ("megajoule", "MJ", "energy", 1e6, 0, None, []),
    ("gigajoule", "GJ", "energy", 1e9, 0, None, []),
    ("calorie", "cal", "energy", 4.184, 0, None, ["卡"]),
    ("kilocalorie", "kcal", "energy", 4184.0, 0, None, ["千卡", "大卡"]),
    ("watt_hour", "Wh", "energy", 3600.0, 0, None, ["瓦时"]),
    ("kilowatt_hour", "kWh", "energy", 3.6e6, 0, None, ["千瓦时", "度"]),
    ("megawatt_hour", "MWh", "energy", 3.6e9, 0, None, []),
    ("btu", "BTU", "energy", 1055.05585262, 0, None, ["英热单位"]),
    ("electronvolt", "eV", "energy", 1.602176634e-19, 0, None, []),
    ("watt", "W", "power", 1.0, 0, 0.0, []),
    ("kilowatt", "kW", "power", 1000.0, 0, None, []),
    ("megawatt", "MW", "power", 1e6, 0, None, []),
    ("gigawatt", "GW", "power", 1e9, 0, None, []),
    ("horsepower", "hp", "power", 745.699871582, 0, None, ["马力"]),
    ("newton", "N", "force", 1.0, 0, None, []),
    ("kilonewton", "kN", "force", 1000.0, 0, None, []),
    ("lbf", "lbf", "force", 4.4482216152605, 0, None, ["磅力"]),
    ("dyne", "dyn", "force", 1e-5, 0, None, []),
    ("kg_per_cubic_meter", "kg/m³", "density", 1.0, 0, None, ["kg/m3", "kg_per_m3"]),
    ("g_per_cubic_cm", "g/cm³", "density", 1000.0, 0, None, ["g/cm3", "g_per_cm3", "克每立方厘米"]),
    ("kg_per_liter", "kg/L", "density", 1000.0, 0, None, ["kg/l", "kg_per_l"]),
    ("lb_per_cubic_foot", "lb/ft³", "density", 16.018463374, 0, None, ["lb/ft3", "lb_per_ft3"]),
    ("mol_per_cubic_meter", "mol/m³", "concentration_molar", 1.0, 0, None, ["mol/m3"]),
    ("mol_per_liter", "mol/L", "concentration_molar", 1000.0, 0, None, ["M", "mol/l", "mol_per_l", "摩尔每升"]),
    ("percent", "%", "dimensionless", 0.01, 0, None, ["pct", "百分"]),
    ("ppm", "ppm", "dimensionless", 1e-6, 0, 0.0, ["parts_per_million", "百万分率"]),
    ("ppb", "ppb", "dimensionless", 1e-9, 0, None, ["parts_per_billion", "+亿分率"]),
    ("wt_percent", "wt%", "dimensionless", 0.01, 0, None, ["质量分数", "质量百分比"]),
    ("mass_ppm", "mass_ppm", "dimensionless", 1e-6, 0, None, []),
    ("cubic_meter_per_second", "m³/s", "flow", 1.0, 0, None, ["m3/s"]),
    ("liter_per_minute", "L/min", "flow", 0.001 / 60.0, 0, None, ["lpm", "l/min", "升每分钟"]),
    ("cubic_meter_per_hour", "m³/h", "flow", 1.0 / 3600.0, 0, None, ["m3/h", "立方米每小时"]),
    ("gallon_per_minute", "gpm", "flow", 0.0000630901964, 0, None, ["gal/min", "美加仑每分钟"]),
    ("kg_per_second", "kg/s", "mass_flow", 1.0, 0, None, ["千克每秒"]),
    ("ton_per_hour", "t/h", "mass_flow", 1000.0 / 3600.0, 0, None, ["吨每小时"]),
    ("kg_per_minute", "kg/min", "mass_flow", 1.0 / 60.0, 0, None, ["千克每分钟"]),
    ("ton_per_day", "t/d", "mass_flow", 1000.0 / 86400.0, 0, None, ["吨每天"]),
    ("meter_per_second", "m/s", "velocity", 1.0, 0, None, ["米每秒"]),
    ("km_per_hour", "km/h", "velocity", 1000.0 / 3600.0, 0, None, ["kph", "千米每小时", "公里每小时"]),
    ("foot_per_second", "ft/s", "velocity", 0.3048, 0, None, ["英尺每秒"]),
    ("mile_per_hour", "mph", "velocity", 0.44704, 0, None, ["英里每小时"]),
    ("pascal_second", "Pa·s", "viscosity_dynamic", 1.0, 0, 0.0, ["Pa s", "Pa*s"]),
    ("centipoise", "cP", "viscosity_dynamic", 0.001, 0, 0.0, ["厘泊"]),
    ("poise", "P", "viscosity_dynamic", 0.1, 0, 0.0, ["泊"]),
    ("square_meter_per_second", "m²/s", "viscosity_kinematic", 1.0, 0, 0.0, ["m2/s"]),
    ("centistoke", "cSt", "viscosity_kinematic", 1e-6, 0, 0.0, ["厘斯"]),
    ("stoke", "St", "viscosity_kinematic", 1e-4, 0, 0.0, ["斯托克斯"]),
    ("joule_per_kg", "J/kg", "specific_energy", 1.0, 0, None, []),
    ("kWh_per_ton", "kWh/t", "specific_energy", 3600.0, 0, None, ["千瓦时每吨"]),
    ("MJ_per_ton", "MJ/t", "specific_energy", 1000.0, 0, None, []),
    ("kJ_per_kg", "kJ/kg", "specific_energy", 1000.0, 0, None, []),
    ("J_per_kg_K", "J/(kg·K)", "heat_capacity_specific", 1.0, 0, None, ["J/(kg*K)"]),
    ("kJ_per_kg_K", "kJ/(kg·K)", "heat_capacity_specific", 1000.0, 0, None, ["kJ/(kg*K)"]),
    ("J_per_mol_K", "J/(mol·K)", "heat_capacity_molar", 1.0, 0, None, ["J/(mol*K)"]),
    ("W_per_m_K", "W/(m·K)", "thermal_conductivity", 1.0, 0, 0.0, ["W/(m*K)"]),
    ("kcal_per_h_m_K", "kcal/(h·m·K)", "thermal_conductivity", 1.16222222, 0, None, ["千卡每小时米开"]),
    ("W_per_cm_K", "W/(cm·K)", "thermal_conductivity", 100.0, 0, None, ["W/(cm*K)"]),
]

# ---- fixed values: dimensions: exponents of L M T Theta N I J, and the category a dimension is reported as ----
DIMENSIONS = [
    ("length", [1, 0, 0, 0, 0, 0, 0], "length"),
    ("mass", [0, 1, 0, 0, 0, 0, 0], "mass"),
    ("time", [0, 0, 1, 0, 0, 0, 0], "time"),
    ("temp", [0, 0, 0, 1, 0, 0, 0], "temperature"),
    ("amount", [0, 0, 0, 0, 1, 0, 0], "amount"),
    ("area", [2, 0, 0, 0, 0, 0, 0], "area"),
    ("volume", [3, 0, 0, 0, 0, 0, 0], "volume"),
    ("velocity", [1, 0, -1, 0, 0, 0, 0], "velocity"),
    ("force", [1, 1, -2, 0, 0, 0, 0], "force"),
    ("pressure", [-1, 1, -2, 0, 0, 0, 0], "pressure"),
    ("energy", [2, 1, -2, 0, 0, 0, 0], "energy"),
    ("power", [2, 1, -3, 0, 0, 0, 0], "power"),
    ("density", [-3, 1, 0, 0, 0, 0, 0], "density"),
    ("concentration_molar", [-3, 0, 0, 0, 1, 0, 0], "concentration"),
    ("flow", [3, 0, -1, 0, 0, 0, 0], "flow"),
    ("mass_flow", [0, 1, -1, 0, 0, 0, 0], "mass_flow"),
    ("viscosity_dynamic", [-1, 1, -1, 0, 0, 0, 0], "viscosity_dynamic"),
    ("viscosity_kinematic", [2, 0, -1, 0, 0, 0, 0], "viscosity_kinematic"),
    ("specific_energy", [2, 0, -2, 0, 0, 0, 0], "specific_energy"),
    ("thermal_conductivity", [1, 1, -3, -1, 0, 0, 0], "thermal_conductivity"),
    ("heat_capacity_specific", [2, 0, -2, -1, 0, 0, 0], "unknown"),
    ("heat_capacity_molar", [2, 0, -2, -1, -1, 0, 0], "unknown"),
    ("dimensionless", [0, 0, 0, 0, 0, 0, 0], "dimensionless"),
]


def atomic_weights() -> list[tuple[str, float]]:
    return [(a, float(w)) for a, w in ATOMIC_WEIGHTS]


def valences() -> list[tuple[str, int]]:
    return [(element, v) for element, known in VALENCES for v in known]


def reactions() -> list[tuple[int, str, float, float, str]]:
    return [(i, *r) for i, r in enumerate(REACTIONS)]


def shomate() -> list[tuple]:
    """(ordinal, species, t_min, t_max, A..H)"""
    return [(i, species, *map(float, numbers)) for i, (species, *numbers) in enumerate(SHOMATE)]


@cache
def dimensions() -> dict[str, tuple[str, str]]:
    """name -> (exponents as text, reported category)"""
    return {name: (" ".join(map(str, exponents)), category) for name, exponents, category in DIMENSIONS}


@cache
def units() -> list[tuple]:
    """(ordinal, name, symbol, dimension, reported category, factor, offset, least value or None)"""
    return [(i, name, symbol, *dimensions()[dim], float(factor), float(offset), least) for i, (name, symbol, dim, factor, offset, least, _) in enumerate(UNITS)]


@cache
def unit_keys() -> list[tuple[str, int, int]]:
    """(key, tier, ordinal of the unit): tier 0 names, 1 symbols and aliases (the last registration wins), 2 any of them lower-cased."""
    names, exact, folded = {}, {}, {}
    for i, (name, symbol, *_, aliases) in enumerate(UNITS):
        names[name] = i
        exact |= dict.fromkeys([symbol, *aliases], i)
        for key in (name, symbol, *aliases):
            folded.setdefault(key.lower(), i)
    return [(k, tier, i) for tier, table in enumerate((names, exact, folded)) for k, i in table.items()]


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else str(value)


def values_sql(rows: list[tuple], name: str, columns: str) -> str:
    """A DuckDB table expression for literal rows."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS {name}({columns})"


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal DataFrame."""
    return spark.createDataFrame(rows, schema)


def picked_sql(rows: list[tuple], columns: str, source: str, key: str) -> str:
    """DuckDB: each row of ``source`` with the literal row whose place is ``key`` modulo their number."""
    numbered = values_sql([(i, *r) for i, r in enumerate(rows)], "lit", f"_i, {columns}")
    return f"(SELECT * FROM {source} JOIN {numbered} ON _i = {key} % {len(rows)})"


def picked(df: DataFrame, rows: list[tuple], schema: str, key: str) -> DataFrame:
    """Each row of ``df`` with the literal row whose place is ``key`` modulo their number."""
    numbered = table(df.sparkSession, [(i, *r) for i, r in enumerate(rows)], f"_i long, {schema}")
    return df.join(F.broadcast(numbered), F.col("_i") == F.col(key) % len(rows))  # the literal rows
